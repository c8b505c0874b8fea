"""Spark jobs that prepare large graphs for mini-batch learning on several workers."""
