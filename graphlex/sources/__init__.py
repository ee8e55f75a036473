"""Readers, writers, generators, and the graph and sequence views over the driver's tables."""
