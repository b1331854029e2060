"""grafonda: knowledge-graph analytics over text, expressed as Spark plans."""

__version__ = "0.1.0"
