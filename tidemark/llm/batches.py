"""How many rows go to Python at once."""

from __future__ import annotations

from tidemark.session import small_batches

__all__ = ["small_batches"]
