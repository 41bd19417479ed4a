"""Job-listing analytics as PySpark DataFrame jobs."""
