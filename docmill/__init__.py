"""docmill: a PySpark-native document analytics, access-control and retrieval engine."""
