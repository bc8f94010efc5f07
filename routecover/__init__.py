"""Spark jobs for trail and road networks, and for preparing training text."""
