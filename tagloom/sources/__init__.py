"""Readers and writers of text tables, JSON lines and indexes."""
