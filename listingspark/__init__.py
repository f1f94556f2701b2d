"""PySpark-native analytics over retail vehicle listings."""
