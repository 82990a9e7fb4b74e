"""hearthlog: a PySpark-native engine for personal social archives."""
