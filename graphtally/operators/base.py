"""What every estimator offers: a summary built once per graph, and estimates that read it."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable

from ..plans.pattern import Pattern
from ..plans.store import Store
from .graph import Graph


class Estimator(ABC):
    """Adding one is a subclass; ``summarize`` writes what it needs of a graph, ``estimate`` reads that."""

    name = ""
    #: Whether repeated runs give one estimate.
    fixed = False
    #: Whether ``trials(g, p, seeds, summary)`` makes all trials at once, as rows (seed, est).
    batched = False
    #: Whether an estimate depends on edges of labels that its pattern doesn't name.
    whole = False

    def summarize(self, g: Graph, store: Store, patterns: Iterable[Pattern] | None = None) -> Store:
        """Build the summary's tables in ``store``; those that are there already stay. Samplers have none.

        With ``patterns`` the tables may leave out what none of these asks for; their estimates are the same.
        """
        return store

    @abstractmethod
    def estimate(self, g: Graph, p: Pattern, seed: int = 0, summary: Store | None = None) -> float:
        """The estimated number of matches; without a summary one is built for this call."""

    def summary_of(self, g: Graph, summary: Store | None, p: Pattern) -> Store:
        return summary if summary is not None else self.summarize(g, Store.scratch(g.edges.sparkSession), [p])


def asked_labels(patterns: Iterable[Pattern]) -> tuple[set[int], set[int]]:
    """Edge and vertex labels that patterns name."""
    patterns = list(patterns)
    return {e.el for p in patterns for e in p.edges}, {v.label for p in patterns for v in p.vertices} - {None}


def summary_path(data: str, method: str, ratio: float, seed: int = 0, budget: int | None = None) -> str:
    """Where a summary of a data file lies."""
    return f"{data}.{method}.b{budget}" if budget is not None else f"{data}.{method}.p{ratio:g}.s{seed}"


def empty(g: Graph, p: Pattern) -> bool:
    """Whether a label of the pattern does not occur."""
    return any(not g.counts["el"].get(e.el) for e in p.edges) or any(v.label is not None and not g.counts["vl"].get(v.label) for v in p.vertices)
