"""PySpark-native territorial analytics engine."""
