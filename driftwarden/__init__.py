"""Migration drift detection and reconciliation, expressed as Spark jobs."""
