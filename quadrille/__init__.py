"""quadrille: analytics on named-graph quads and the tables derived from them, on PySpark."""

__version__ = "0.1.0"
