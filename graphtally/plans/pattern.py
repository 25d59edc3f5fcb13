"""Query patterns on the driver: parsing, validation, relations and their join order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class PVertex:
    id: int
    label: int | None = None
    bound: int | None = None


@dataclass(frozen=True)
class PEdge:
    src: int
    dst: int
    el: int


@dataclass(frozen=True)
class Pattern:
    vertices: tuple[PVertex, ...]
    edges: tuple[PEdge, ...]

    def __post_init__(self) -> None:
        n = len(self.vertices)
        if [v.id for v in self.vertices] != list(range(n)):
            raise ValueError("pattern vertices are numbered from 0 in order")
        for e in self.edges:
            if not (0 <= e.src < n and 0 <= e.dst < n):
                raise ValueError(f"edge {e} names no vertex")

    @classmethod
    def from_lines(cls, lines: Iterable[str]) -> Pattern:
        """``v id label bound`` and ``e src dst label`` lines; -1 or a missing field is none."""
        vs, es = [], []
        for line in lines:
            t = line.split()
            if not t:
                continue
            if t[0] == "v":
                n = [int(x) for x in t[1:]] + [-1, -1]
                vs.append(PVertex(n[0], None if n[1] < 0 else n[1], None if n[2] < 0 else n[2]))
            elif t[0] == "e":
                es.append(PEdge(int(t[1]), int(t[2]), int(t[3])))
        return cls(tuple(vs), tuple(es))

    @classmethod
    def read(cls, path: str | Path) -> Pattern:
        return cls.from_lines(Path(path).read_text().splitlines())

    @classmethod
    def of(cls, edges: Iterable[tuple[int, int, int]], labels: dict[int, int] | None = None, bounds: dict[int, int] | None = None) -> Pattern:
        es = tuple(PEdge(*e) for e in edges)
        n = 1 + max(max(e.src, e.dst) for e in es)
        return cls(tuple(PVertex(i, (labels or {}).get(i), (bounds or {}).get(i)) for i in range(n)), es)

    def out_edges(self, v: int) -> list[int]:
        return [i for i, e in enumerate(self.edges) if e.src == v]

    def in_edges(self, v: int) -> list[int]:
        return [i for i, e in enumerate(self.edges) if e.dst == v]

    def edge_label(self, u: int, v: int) -> int | None:
        return next((e.el for e in self.edges if (e.src, e.dst) == (u, v)), None)

    def parts(self) -> list[Pattern]:
        """The connected parts, each with its vertices numbered anew."""
        group = list(range(len(self.vertices)))
        for e in self.edges:
            a, b = group[e.src], group[e.dst]
            group = [min(a, b) if x in (a, b) else x for x in group]
        out = []
        for root in sorted({group[e.src] for e in self.edges}):
            own = {v: i for i, v in enumerate(v for v in range(len(group)) if group[v] == root)}
            vs = tuple(PVertex(i, self.vertices[v].label, self.vertices[v].bound) for v, i in own.items())
            out.append(Pattern(vs, tuple(PEdge(own[e.src], own[e.dst], e.el) for e in self.edges if e.src in own)))
        return out

    def without_bounds(self) -> Pattern:
        return Pattern(tuple(PVertex(v.id, v.label) for v in self.vertices), self.edges)

    def join_order(self, stats: dict) -> list[int]:
        """Edges in the order of least estimated intermediate rows."""
        return [i for i, _ in self.join_steps(stats)]

    def join_steps(self, stats: dict) -> list[tuple[int, float]]:
        """Edges in the order of least estimated intermediate rows, with the rows after each.

        ``stats``: rows (``el``) and distinct ends (``src``, ``dst``) of each edge label.  A
        join has |R||S| / max(distinct) rows for each vertex that both sides hold; the
        greedy order from every start edge is costed, and the cheapest taken.
        """
        n = len(self.edges)

        def relation(i: int) -> tuple[float, dict[int, float]]:
            e = self.edges[i]
            rows, ends = float(stats["el"].get(e.el, 0)), {}
            for v, side in ((e.src, "src"), (e.dst, "dst")):
                values = max(1.0, float(stats[side].get(e.el, 1)))
                if self.vertices[v].bound is not None:
                    rows, values = rows / values, 1.0
                elif self.vertices[v].label is not None:
                    share = min(1.0, stats["vl"].get(self.vertices[v].label, 0) / max(1, stats["v"]))
                    values = max(1.0, values * max(share, 1e-9))
                ends[v] = min(values, ends.get(v, values))
            return rows, ends

        whole = [relation(i) for i in range(n)]

        def joined(rows: float, ends: dict[int, float], i: int) -> tuple[float, dict[int, float]]:
            more, own = whole[i]
            out = rows * more
            for v in ends.keys() & own.keys():
                out /= max(ends[v], own[v])
            values = {v: min(ends.get(v, own.get(v, 0.0)), own.get(v, ends.get(v, 0.0)), max(out, 1.0)) for v in ends.keys() | own.keys()}
            return out, values

        best: tuple[float, list[tuple[int, float]]] | None = None
        for start in range(n):
            (rows, ends), order, cost = whole[start], [(start, whole[start][0])], whole[start][0]
            while len(order) < n:
                left = [i for i in range(n) if i not in [j for j, _ in order]]
                i = min(left, key=lambda i: (not (ends.keys() & whole[i][1].keys()), joined(rows, ends, i)[0], whole[i][0], i))
                rows, ends = joined(rows, ends, i)
                cost += rows
                order.append((i, rows))
            if best is None or cost < best[0]:
                best = cost, order
        return best[1] if best else []


@dataclass
class PRelation:
    """``table``: ('e', label) or ('v', label); ``attrs``: kept (attribute, column) pairs; ``bounds``: column to constant."""

    table: tuple[str, int]
    attrs: list[tuple[int, int]] = field(default_factory=list)
    bounds: dict[int, int] = field(default_factory=dict)


def relations(p: Pattern) -> list[PRelation]:
    """The pattern as relations over attributes: one per labelled vertex, one per edge.

    An unbound attribute that only one relation holds is projected away.
    """
    uses = [0] * len(p.vertices)
    for v in p.vertices:
        uses[v.id] += v.label is not None and v.bound is None
    for e in p.edges:
        uses[e.src] += 1
        uses[e.dst] += 1
    out = []

    def relation(table: tuple[str, int], ends: list[int]) -> None:
        r = PRelation(table)
        for column, a in enumerate(ends):
            if p.vertices[a].bound is not None:
                r.bounds[column] = p.vertices[a].bound
            elif uses[a] > 1:
                r.attrs.append((a, column))
        out.append(r)

    for v in p.vertices:
        if v.label is not None:
            relation(("v", v.label), [v.id])
    for e in p.edges:
        relation(("e", e.el), [e.src, e.dst])
    return out
