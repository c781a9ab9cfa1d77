"""Lead-intelligence analytics on PySpark: DataFrame and SQL operators over public-register style data."""
