"""Spark-native recognition, price analytics and corpus preparation."""
