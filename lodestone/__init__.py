"""lodestone: hybrid retrieval, ranking evaluation and corpus preparation written as Spark DataFrame programs."""

__version__ = "0.1.0"
