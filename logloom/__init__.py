"""Spark-native log templating: log lines in, wildcard templates and slot summaries out."""
