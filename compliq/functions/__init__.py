"""Text functions, as Spark columns and, where a driver or a Python worker needs the same result, as Python functions."""
