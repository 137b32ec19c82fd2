"""Settings as nested mappings."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


def merged(base: Mapping[str, Any], overrides: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with ``overrides`` on top: mappings merge at every depth, anything else replaces; "a.b" stands for b within a."""
    out: dict[str, Any] = dict(base)
    for name, value in overrides.items():
        head, _, rest = str(name).partition(".")
        if rest:
            value = {rest: value}
        under = out.get(head)
        out[head] = merged(under if isinstance(under, Mapping) else {}, value) if isinstance(value, Mapping) else value
    return out
