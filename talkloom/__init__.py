"""Transcript and text analytics as Spark DataFrame operators."""
