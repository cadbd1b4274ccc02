"""Operators on labeled matrices; each one only builds a Spark plan."""
