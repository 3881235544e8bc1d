"""Spark-native analytics for crop-diagnosis records, dataset curation and classifier evaluation."""
