"""Spark-native engine for lexical-novelty mining over large dated text corpora."""
