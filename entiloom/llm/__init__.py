"""Operators for preparing language-model training data, each built as Spark jobs over whole tables."""
