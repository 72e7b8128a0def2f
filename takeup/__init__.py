"""Multi-label propensity features, scoring and blending as Spark jobs."""

__version__ = "0.1.0"
