"""Severe-weather news and wind analytics as Spark operators."""
