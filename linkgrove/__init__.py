"""Threshold-optimised single-linkage clustering and related operators on Spark."""
