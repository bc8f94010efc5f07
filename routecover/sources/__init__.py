"""Readers and writers of ways, features, heights, selections, tracks."""
