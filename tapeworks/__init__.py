"""Spark jobs for market bars, news sentiment and usage data."""
