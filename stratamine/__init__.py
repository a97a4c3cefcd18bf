"""Data mining and analytics as Spark plans."""
