"""Column expressions. All are built-in Spark functions; there are no UDFs."""
