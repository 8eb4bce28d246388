from .tables import deduplicate, shared_checkpoint, table

__all__ = ["deduplicate", "shared_checkpoint", "table"]
