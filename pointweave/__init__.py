"""Spark-native analytics over point tables, frame sequences and telemetry logs."""
