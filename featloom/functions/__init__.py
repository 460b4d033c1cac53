"""SQL text helpers shared by every operator."""

from featloom.functions.sqltext import display, literal, quote

__all__ = ["display", "literal", "quote"]
