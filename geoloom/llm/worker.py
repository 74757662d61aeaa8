"""What a Python worker keeps between tasks: the tables of one operator at a time.

Workers are reused from stage to stage, so the caches of an earlier operator
would otherwise stay in memory beside those of the next.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

_HELD: dict[str, dict] = {}


def held(group: str, key: Any, make: Callable[[], Any]) -> Any:
    """The group's object for key, made when first asked for; other groups' objects are let go."""
    if group not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
        _HELD[group] = {}
    own = _HELD[group]
    if key not in own:
        own[key] = make()
    return own[key]
