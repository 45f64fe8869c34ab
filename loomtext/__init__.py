"""loomtext: a PySpark-native engine for condensing, screening and measuring large text corpora."""
