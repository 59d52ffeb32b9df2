"""Spark-native detection, pseudonymisation and restoring of personal data."""
