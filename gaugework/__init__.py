"""gaugework: measurement analytics over evaluation data, as Spark plans."""

__version__ = "0.1.0"
