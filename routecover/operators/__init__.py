"""Joins, graph loops and route operators, all as DataFrame functions."""
