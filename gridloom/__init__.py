"""Consolidation of inconsistent tabular files on Spark."""
