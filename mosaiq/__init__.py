"""Segment integrity analytics on Spark."""
