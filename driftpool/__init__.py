"""driftpool: news x price analytics as Spark DataFrame operators."""

__all__ = ["session", "fixtures"]
