"""tarn: PostgreSQL query semantics expressed as Spark DataFrame and SQL plans."""
