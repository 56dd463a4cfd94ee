"""Faultline: pipeline-incident analytics as Spark DataFrame operators."""
