"""Airport-mapping analytics as Spark jobs: sources, conflation, layers, lookups, streams."""

__version__ = "0.1.0"
