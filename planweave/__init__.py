"""planweave: schedule-version comparison and corpus preparation on PySpark."""
