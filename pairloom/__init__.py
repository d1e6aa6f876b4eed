"""Question/SQL pair preparation, screening, evaluation and run telemetry on Spark."""
