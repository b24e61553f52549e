"""tessera: corpus analytics and change-planning operators expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
