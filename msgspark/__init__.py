"""A PySpark-native engine for message catalogs and the dataflow around them."""
