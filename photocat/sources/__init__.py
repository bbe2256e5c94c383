"""Readers and writers of catalogue files."""
