"""sectloom: section analytics over document sections, as Spark DataFrame operators."""

__version__ = "0.1.0"
