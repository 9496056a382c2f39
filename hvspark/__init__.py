"""Associative analytics over sparse high-dimensional vectors, as Spark DataFrame plans."""
