"""Readers of point, frame and log files as distributed Spark jobs."""
