"""Readers from raw bodies to typed rows, and writers of tables and published files."""
