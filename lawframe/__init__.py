"""Spark-native analytics over symbolic-formalization attempts."""
