"""Transcript and corpus analytics on Spark."""
