"""Front-end exposure analytics over tables of captured web responses, on Spark."""

__version__ = "0.1.0"
