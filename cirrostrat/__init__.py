"""Spark-native analytics on gridded forecast ensembles."""
