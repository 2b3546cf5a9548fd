"""PySpark-native analytics for daily entity-by-date panels."""
