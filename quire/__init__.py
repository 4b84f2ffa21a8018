"""quire: document knowledge-graph analytics declared as Spark plans."""

__version__ = "0.1.0"
