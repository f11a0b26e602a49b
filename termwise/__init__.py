"""Student-lifecycle analytics as PySpark DataFrame jobs."""
