"""Spark-native peptide identification analytics."""
