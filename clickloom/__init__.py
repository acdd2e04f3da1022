"""Web event analytics as Spark jobs: load, repair, model, refresh, merge, audit, clone."""
