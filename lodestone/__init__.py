"""Passage search and ranking on Spark."""
