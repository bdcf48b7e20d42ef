"""Spark-native analytics over SQL script corpora and the tables behind them."""
