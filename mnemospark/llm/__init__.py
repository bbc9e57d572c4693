"""Operators for large text and vector collections. Nothing outside this folder imports it."""
