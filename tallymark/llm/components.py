"""Connected components, as the corpus operators use them."""

from __future__ import annotations

from tallymark.operators.components import PER_TASK, components, in_tasks

__all__ = ["PER_TASK", "components", "in_tasks"]
