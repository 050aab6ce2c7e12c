"""Readers and writers of message and depth files."""
