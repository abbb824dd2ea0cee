"""Connected components, as the library has them."""

from __future__ import annotations

from ductwise.operators.components import components

__all__ = ["components"]
