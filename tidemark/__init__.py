"""Causal event-data analytics on Spark."""
