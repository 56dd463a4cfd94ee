"""Readers and writers for the log lake."""
