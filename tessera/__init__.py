"""PySpark-native engine for versioned, auditable Parquet datasets."""
