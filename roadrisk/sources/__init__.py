"""Readers and writers of files, tables and models."""
