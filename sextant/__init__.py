"""Hybrid lexical and vector retrieval over large corpora, in Spark's own terms."""
