"""Code-security analytics as Spark jobs."""
