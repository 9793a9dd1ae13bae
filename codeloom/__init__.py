"""Codeloom: a PySpark-native code-intelligence engine for database program code."""
