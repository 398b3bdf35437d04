"""PySpark-native contract checking for documents and tables."""
