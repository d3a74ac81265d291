"""Spark-native search, upkeep and curation of a collection of nested JSON records."""
