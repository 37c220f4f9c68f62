"""shelfwise: a PySpark-native engine for cataloguing large media collections."""
