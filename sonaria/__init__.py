"""sonaria: speech-data jobs on Spark DataFrames and Structured Streaming."""
