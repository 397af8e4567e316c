"""Operators of training-data pipelines (tagged ``llm``). Nothing outside this package imports it."""
