"""Provider-risk analytics as plain DataFrame-to-DataFrame Spark jobs."""
