"""Risk classification with Spark ML."""
