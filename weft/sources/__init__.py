"""Readers and writers of graphs, stores and side tables."""
