"""PySpark-native analytics over signal-derived feature vectors."""
