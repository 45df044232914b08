"""Terrane: gridded and positioned geoscience analytics as Spark DataFrame operators."""
