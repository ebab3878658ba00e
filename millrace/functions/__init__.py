"""Column builders: text, dates, numbers and digests. None of them is a UDF."""
