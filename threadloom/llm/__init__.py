"""Operators of a training-data pipeline. Each module is one operator; ``queries`` registers them."""
