"""Spark-native reconstruction of time-ordered tracks across reporting gaps."""
