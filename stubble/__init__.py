"""Field-survey curation on PySpark: harmonise, audit, calculate, gap-fill, publish."""

__version__ = "0.1.0"
