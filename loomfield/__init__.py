"""Corpus tension analytics on Spark: retrieval, scoring, clustering and graph queries over text corpora."""
