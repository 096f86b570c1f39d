"""Readers and writers. Every format is a pair of functions between a text column and token rows."""
