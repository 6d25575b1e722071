"""Web-data quality and drift analytics as Spark DataFrame operators."""
