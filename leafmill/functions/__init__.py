from . import text, unicode

__all__ = ["text", "unicode"]
