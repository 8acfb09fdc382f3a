"""Varve: versioned key-value and property-graph analytics on PySpark."""
