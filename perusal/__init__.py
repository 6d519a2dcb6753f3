"""perusal: a PySpark-native engine for tracking scholarly literature and preparing text corpora."""
