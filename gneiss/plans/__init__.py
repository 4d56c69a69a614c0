"""The registered queries: importing the modules fills the registry."""

from gneiss.plans import evidence, images, registry

__all__ = ["evidence", "images", "registry"]
