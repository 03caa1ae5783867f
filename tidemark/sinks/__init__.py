"""Row layouts of the result files; writing goes through Spark's own writers."""
