"""All registered queries."""

from __future__ import annotations

from twinspan.catalog import clones, evaluation, segments, semantics, summaries, texts
from twinspan.catalog.common import Registry

MODULES = (texts, segments, clones, semantics, summaries, evaluation)


def build() -> Registry:
    registry = Registry()
    for module in MODULES:
        module.register(registry)
    return registry
