"""Relational operators over frames and samples."""
