"""loomwork: table operators and data-profiling jobs written as Spark plans."""

__version__ = "0.1.0"
