"""Comparative variant analytics as composable Spark DataFrame operators."""
