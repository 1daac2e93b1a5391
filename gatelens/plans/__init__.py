"""Configuration, the stage planner and the registered queries."""
