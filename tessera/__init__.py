"""PySpark-native engine for structuring, verifying and preparing document corpora."""
