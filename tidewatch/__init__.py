"""Trading-abuse surveillance of on-chain swap tables, written as Spark DataFrame plans."""

__version__ = "0.1.0"
