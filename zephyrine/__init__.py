"""Zephyrine: Spark-native time-series normalisation and counterfactual analysis."""

__version__ = "0.1.0"
