"""riwaya: evidence-backed text linking and lookup, expressed as Spark plans."""

__version__ = "0.1.0"
