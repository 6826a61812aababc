"""factloom: a PySpark-native engine for claim verification and text-corpus processing."""
