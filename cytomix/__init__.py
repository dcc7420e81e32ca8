"""cytomix: expression analytics as Spark DataFrame jobs."""
