"""bitext_engine: Spark jobs over collections of legal documents and their translations."""

__version__ = "0.1.0"
