"""Operators of a training-data pipeline over web pages and documents."""
