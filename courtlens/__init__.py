"""courtlens: a Spark-native engine for frame-indexed court-side signals and their evaluation."""
