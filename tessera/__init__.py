"""A PySpark-native engine for preparing and auditing language-model training data."""
