"""Readers and writers: text lists, profile files, pair stores, test views."""
