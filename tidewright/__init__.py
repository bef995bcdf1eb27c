"""Spark-native document round-trip, fidelity and corpus-preparation engine."""
