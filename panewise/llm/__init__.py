"""Operators of a training-data pipeline on Spark. Nothing else in the package imports them."""
