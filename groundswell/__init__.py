"""Groundswell: point-cloud and terrain analytics as Spark DataFrame plans."""
