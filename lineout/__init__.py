"""Batted-ball analytics as Spark DataFrame operators."""
