"""Spark-native privacy and knowledge-graph analytics: DataFrame -> DataFrame operators."""
