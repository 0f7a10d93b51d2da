"""A Spark-first engine for practice analytics, document layout and document text."""
