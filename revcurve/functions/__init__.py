"""Column-level helpers: the fixed vocabulary and exact integer money arithmetic."""

from revcurve.functions import domain, money

__all__ = ["domain", "money"]
