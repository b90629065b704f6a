"""corpuslake: a PySpark-native engine for web-document corpora."""
