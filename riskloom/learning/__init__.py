"""Training, evaluation and batch scoring with Spark ML."""
