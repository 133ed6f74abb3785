"""Spark-native analytics for technical regulations, building models and their logs."""
