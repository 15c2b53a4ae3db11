"""Temporal recall over conversation tables, written as Spark DataFrame operators."""
