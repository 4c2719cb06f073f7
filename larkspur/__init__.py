"""Conversational-memory analytics and training-text processing on PySpark."""
