"""Spark-native document structuring: decoders, block operators, rendering."""
