"""Community-text analytics as Spark jobs: harvest, clean, annotate, report."""

__version__ = "0.1.0"
