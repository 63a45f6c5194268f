"""Best-frame selection and corpus preparation as Spark jobs."""
