"""corpusloom: a PySpark-native engine that builds, checks and packs text corpora."""
