"""A PySpark-native engine for knowledge-store analytics and retrieval."""
