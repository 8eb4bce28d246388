from . import more, registry, web

__all__ = ["more", "registry", "web"]
