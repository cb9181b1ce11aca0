"""Ticktide: a PySpark-native engine for tick, order-book and event time-series analytics."""
