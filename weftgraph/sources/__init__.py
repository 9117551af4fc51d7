"""Readers and writers of graphs, edge lists and embeddings."""
