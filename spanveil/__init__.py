"""Spark-native detection, fusion and masking of personal data in text tables."""
