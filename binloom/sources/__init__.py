"""Readers and writers of tables, layouts and configurations."""
