"""Spark-native read models over event histories."""
