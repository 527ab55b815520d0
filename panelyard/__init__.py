"""Point-in-time analytics over entity-by-day panels, written as Spark jobs."""
