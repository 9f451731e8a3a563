"""A PySpark-native engine for searching and analysing libraries of paged documents."""
