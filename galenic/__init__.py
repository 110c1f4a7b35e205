"""A PySpark-native engine for a medicine catalogue: load, classify, search and summarise."""
