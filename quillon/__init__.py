"""Feature-table audits and signal analytics as Spark jobs: DataFrames in, DataFrames out, explicit keys."""
