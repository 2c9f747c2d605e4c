"""A PySpark-native engine for document layout data and training-data preparation."""
