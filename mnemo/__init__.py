"""mnemo: a versioned semantic-memory engine expressed as Spark DataFrames."""
