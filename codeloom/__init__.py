"""PySpark-native code-intelligence and corpus analytics."""
