"""Lodestone: a PySpark-native engine for exploring Parquet data."""
