"""corpusloom: a PySpark-native analytics engine for a text corpus and its metadata."""
