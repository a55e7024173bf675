"""Spark-native comparison of prediction-market and option-implied probabilities."""

CALCULATION_VERSION = "1.0.0"
FEATURE_VERSION = "1.0.0"
