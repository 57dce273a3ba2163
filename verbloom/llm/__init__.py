"""Operators for large text and feature collections; nothing outside this package imports it."""
