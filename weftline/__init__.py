"""weftline: a PySpark-native engine for semi-structured, chat and training data."""
