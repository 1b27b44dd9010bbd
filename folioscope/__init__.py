"""folioscope: document quality, provenance and audit analytics as Spark DataFrame transformations."""

__version__ = "0.1.0"
