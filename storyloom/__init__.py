"""storyloom: a PySpark-native engine for narrative memory and text collections."""
