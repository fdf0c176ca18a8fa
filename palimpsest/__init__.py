"""Palimpsest: conversational-memory analytics as DataFrame operators on Spark."""
