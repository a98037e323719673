"""Annotation, key-value evaluation and text-curation operators on Spark DataFrames."""
