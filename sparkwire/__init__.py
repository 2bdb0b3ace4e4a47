"""Spark-native protobuf wire format, schemas and well-known types."""
