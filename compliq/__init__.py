"""Document compliance at corpus scale on Spark: specifications compiled to DataFrame plans."""

__version__ = "0.1.0"
