"""Retrieval methods by name."""

from __future__ import annotations

from collections.abc import Callable

from . import arms, navigate


def native(*_, **__):
    """Names the rows that grade a navigator's own answer; they come with the rows of pageindex."""
    raise ValueError("pageindex_native rows are written by the pageindex arm; ask for 'pageindex'")


#: Methods by name, with the family that each belongs to, and whether a navigator drives it.
ARMS: dict[str, tuple[str, bool, Callable]] = {
    "oracle": ("control", False, arms.oracle),
    "chunk_embed": ("vector", False, arms.chunk_embed),
    "hybrid_rerank": ("vector", False, arms.hybrid_rerank),
    "long_context": ("context", False, arms.long_context),
    "raptor": ("tree", False, arms.raptor),
    "pageindex": ("tree", True, navigate.pageindex),
    "pageindex_native": ("tree", True, native),
    "vec_tree": ("hybrid", True, navigate.vec_tree),
}


def arm(name: str) -> Callable:
    """The method of a name; the error lists the known ones."""
    if name not in ARMS:
        raise ValueError(f"unknown arm {name!r}; known: {', '.join(sorted(ARMS))}")
    return ARMS[name][2]
