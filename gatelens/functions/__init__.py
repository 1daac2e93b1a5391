"""Column functions on gate arrays and scalars."""
