"""foliospark: document refinement and training-data processing as Spark DataFrame plans."""

__version__ = "0.1.0"
