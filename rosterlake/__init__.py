"""Rosterlake: a PySpark-native engine that builds and audits a directory of listings."""
