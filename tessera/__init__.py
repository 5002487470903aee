"""Spark-native matching of messy strings and titles to curated catalogs, and the data jobs around it."""
