"""Hierarchical entity graphs on Spark: build, measure, detect, search and maintain, plus training-data operators."""
