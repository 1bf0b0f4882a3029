"""Spark jobs for public-transport schedule feeds."""
