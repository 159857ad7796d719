"""tessera: a PySpark-native engine for localisation-style text corpora."""
