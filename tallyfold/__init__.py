"""Event-study analytics and training-data preparation on PySpark."""
