"""helixmill: case/control feature analytics and corpus processing as Spark DataFrame jobs."""
