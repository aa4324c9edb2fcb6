"""Spark-native production, checking and analysis of derivation corpora and ordered event traces."""
