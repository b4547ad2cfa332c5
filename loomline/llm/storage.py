"""Cutting lineage, as in the rest of the engine."""

from ..functions.storage import checkpointed

__all__ = ["checkpointed"]
