"""linkrec: link recommendation on large typed graphs, as Spark DataFrame functions."""
