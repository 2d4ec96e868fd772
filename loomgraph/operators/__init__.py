"""Operators over tables of nodes, edges, vectors and partitions."""
