"""Operators of a training-data pipeline over web-scale text; nothing else in the package imports them."""
