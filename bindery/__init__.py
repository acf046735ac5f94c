"""bindery: record integration, data quality and training-data operators on PySpark."""
