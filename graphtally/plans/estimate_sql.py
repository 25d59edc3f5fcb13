"""Estimates of the fixed methods as SQL over ``edges`` and ``vlabels``, for patterns without labels, bounds or repeated edge labels."""

from __future__ import annotations

from ..operators.charsets import CharacteristicSets
from .pattern import Pattern, relations

#: Types of the vertices (ty), and sets of either direction with their frequencies.
TYPES = """, vs AS (SELECT vid, string_agg(vl::VARCHAR, ',' ORDER BY vl) AS vls FROM vlabels GROUP BY vid),
os AS (SELECT vid, string_agg(el::VARCHAR, ',' ORDER BY el) AS outs FROM (SELECT DISTINCT src AS vid, el FROM edges) x GROUP BY vid),
ns AS (SELECT vid, string_agg(el::VARCHAR, ',' ORDER BY el) AS ins FROM (SELECT DISTINCT dst AS vid, el FROM edges) x GROUP BY vid),
ty AS (SELECT vs.vid, vls, coalesce(outs, '') AS outs, coalesce(ins, '') AS ins FROM vs LEFT JOIN os ON vs.vid = os.vid LEFT JOIN ns ON vs.vid = ns.vid)"""


def charsets_sql() -> str:
    """CTEs fwd_n, bwd_n (sets and their vertices), fwd_f, bwd_f (edges of a set by label) and rule (nb, width)."""
    out = ""
    for name, side, els, vls in (("fwd", "src", "outs", "vls"), ("bwd", "dst", "ins", "''")):
        out += f""", {name}_n AS (SELECT {vls} AS k1, {els} AS k2, count(*)::DOUBLE AS n FROM ty GROUP BY ALL),
{name}_f AS (SELECT {vls} AS k1, {els} AS k2, el, count(*)::DOUBLE AS d FROM edges JOIN ty ON edges.{side} = ty.vid GROUP BY ALL)"""
    counts = "(SELECT count(*) FROM fwd_n) + (SELECT count(*) FROM bwd_n)"
    labels = "(SELECT max(vl) + 1 FROM vlabels)"
    return out + f""", rule0 AS (SELECT least((SELECT count(*) FROM ty) + 1, {counts}, (100000000 // ({labels} + (SELECT max(el) + 1 FROM edges)))) AS nb, (SELECT count(*) FROM ty) AS v, {labels} AS nvl),
rule AS (SELECT nb, v, nvl, greatest(1, (v + nvl) // nb) AS width FROM rule0)"""


def cset(p: Pattern) -> str:
    """A scalar expression over the CTEs of ``TYPES`` and ``charsets_sql``."""
    triples, stars, covered, near = CharacteristicSets().decomposed(p)
    factors = []
    for _, forward, use in stars:
        name, labels = ("fwd" if forward else "bwd"), [triples[i][3] for i in use]
        joins = " ".join(f"JOIN {name}_f f{k} ON f{k}.k1 = s.k1 AND f{k}.k2 = s.k2 AND f{k}.el = {el}" for k, el in enumerate(labels))
        factors.append(f"(SELECT coalesce(sum(s.n * {' * '.join(f'f{k}.d / s.n' for k in range(len(labels)))}), 0) FROM {name}_n s {joins})")
    for i, t in enumerate(triples):
        if i not in covered:
            factors.append("(SELECT v::DOUBLE FROM rule)" if i == 0 else f"(SELECT count(*)::DOUBLE FROM edges WHERE el = {t[3]})")
    for i, j in sorted(near):
        a, b = triples[i], triples[j]
        ca, cb = next((x, y) for x in (0, 1) for y in (0, 1) if a[x] == b[y])
        x, y = (f"(SELECT ({('src', 'dst')[c]} + nvl) % nb AS k, count(*)::DOUBLE AS n FROM edges, rule WHERE el = {t[3]} GROUP BY k)" for t, c in ((a, ca), (b, cb)))
        factors.append(f"((SELECT coalesce(sum(x.n * y.n / width), 0) FROM {x} x JOIN {y} y ON x.k = y.k, rule) / ((SELECT count(*)::DOUBLE FROM edges WHERE el = {a[3]}) * (SELECT count(*) FROM edges WHERE el = {b[3]})))")
    return " * ".join(factors)


#: Bounding formulae worked out by hand from the rule, by pattern: positions of the edges that
#: are counted, edges that bound by the degree of a vertex, vertices that are cut into buckets.
BOUNDS = {
    ((0, 1, 1), (2, 1, 2)): [([0], {1: 1}, [1]), ([1], {0: 1}, [1])],
    ((0, 1, 3), (0, 2, 4), (0, 3, 5)): [([0], {1: 0, 2: 0}, [0]), ([1], {0: 0, 2: 0}, [0]), ([2], {0: 0, 1: 0}, [0])],
    ((0, 1, 3), (1, 2, 1), (2, 3, 0)): [([0], {1: 1, 2: 2}, [1]), ([0, 2], {}, [1, 2]), ([1], {0: 1, 2: 2}, [1, 2]), ([2], {1: 2, 0: 1}, [2])],
    ((0, 1, 4), (1, 2, 6), (0, 2, 5)): [([0], {1: 1}, [0, 1]), ([0], {2: 0}, [0, 1]), ([1], {0: 1}, [1, 2]), ([1], {2: 2}, [1, 2]), ([2], {0: 0}, [0, 2]), ([2], {1: 2}, [0, 2])],
    ((0, 1, 3), (1, 2, 1), (3, 2, 2), (0, 3, 5)): [
        *[([0], {i: v, j: w}, [0, 1]) for i, v, j, w in ((1, 1, 2, 2), (1, 1, 3, 0), (2, 3, 3, 0))],
        *[([1], {i: v, j: w}, [1, 2]) for i, v, j, w in ((0, 1, 2, 2), (0, 1, 3, 0), (2, 2, 3, 3))],
        *[([2], {i: v, j: w}, [2, 3]) for i, v, j, w in ((0, 0, 3, 3), (1, 2, 0, 1), (1, 2, 3, 3))],
        *[([3], {i: v, j: w}, [0, 3]) for i, v, j, w in ((0, 0, 1, 1), (0, 0, 2, 3), (1, 2, 2, 3))],
        ([0, 2], {}, [0, 1, 2, 3]),
        ([1, 3], {}, [0, 1, 2, 3]),
    ],
}


def bsk(p: Pattern, budget: int = 4096) -> str:
    """Least of the formulae of ``BOUNDS``."""
    values = []
    for counted, degrees, cut in BOUNDS[tuple((e.src, e.dst, e.el) for e in p.edges)]:
        n = max(1, round(budget ** (1 / len(cut)))) if cut else 1
        tables, held, same = [], {}, []

        def add(body: str, vertices: list[int]) -> None:
            name = f"t{len(tables)}"
            tables.append(f"({body}) {name}")
            for v in vertices:
                same.extend([f"{held[v]} = {name}.a{v}"] if v in held else [])
                held.setdefault(v, f"{name}.a{v}")

        for i in counted:
            e = p.edges[i]
            own = [(v, c) for v, c in ((e.src, "src"), (e.dst, "dst")) if v in cut]
            keys = "".join(f"{c} % {n} AS a{v}, " for v, c in own)
            add(f"SELECT {keys}count(*)::DOUBLE AS v FROM edges WHERE el = {e.el}" + (" GROUP BY ALL" if own else ""), [v for v, _ in own])
        for i, v in degrees.items():
            c = "src" if p.edges[i].src == v else "dst"
            each = f"(SELECT {c}, count(*)::DOUBLE AS c FROM edges WHERE el = {p.edges[i].el} GROUP BY {c}) x"
            add(f"SELECT {c} % {n} AS a{v}, max(c) AS v FROM {each} GROUP BY a{v}" if v in cut else f"SELECT max(c) AS v FROM {each}", [v] if v in cut else [])
        values.append(f"(SELECT coalesce(sum({' * '.join(f't{k}.v' for k in range(len(tables)))}), 0) FROM {', '.join(tables)}{' WHERE ' + ' AND '.join(same) if same else ''})")
    return f"least({', '.join(values)})"


#: Members of the typed summary, and its edges.
SUMMARY = """, m AS (SELECT vid, min(vid) OVER (PARTITION BY vls, outs, ins) AS bucket, count(*) OVER (PARTITION BY vls, outs, ins)::DOUBLE AS size FROM ty),
sb AS (SELECT DISTINCT bucket, size FROM m),
se AS (SELECT a.bucket AS bs, el, b.bucket AS bd, count(*)::DOUBLE AS w FROM edges JOIN m a ON src = a.vid JOIN m b ON dst = b.vid GROUP BY a.bucket, el, b.bucket)"""


def sumrdf(p: Pattern) -> str:
    """With distinct labels no two pattern edges can be one, so only the plain partition counts."""
    tables, conditions, first = [], [], {}
    for i, e in enumerate(p.edges):
        tables.append(f"se e{i}")
        conditions.append(f"e{i}.el = {e.el}")
        for v, c in ((e.src, "bs"), (e.dst, "bd")):
            conditions += [f"{first[v]} = e{i}.{c}"] if v in first else []
            first.setdefault(v, f"e{i}.{c}")
    for v, at in first.items():
        tables.append(f"sb n{v}")
        conditions.append(f"n{v}.bucket = {at}")
    value = " * ".join([f"n{v}.size" for v in first] + [f"(e{i}.w / (n{e.src}.size * n{e.dst}.size))" for i, e in enumerate(p.edges)])
    return f"(SELECT coalesce(sum({value}), 0) FROM {', '.join(tables)} WHERE {' AND '.join(conditions)})"


#: Estimates where edges of one label can be one edge, worked out by hand: what is left for just one way, times its chance.
FAN = """(WITH t AS (SELECT n0.size AS a, x.size AS x, y.size AS y, z.size AS z, e0.w AS w0, e1.w AS w1, e2.w AS w2, (x.bucket = y.bucket)::INT AS xy, (x.bucket = z.bucket)::INT AS xz, (y.bucket = z.bucket)::INT AS yz
FROM se e0 JOIN se e1 ON e0.bs = e1.bs JOIN se e2 ON e0.bs = e2.bs JOIN sb n0 ON n0.bucket = e0.bs JOIN sb x ON x.bucket = e0.bd JOIN sb y ON y.bucket = e1.bd JOIN sb z ON z.bucket = e2.bd WHERE e0.el = 4 AND e1.el = 4 AND e2.el = 4),
u AS (SELECT *, xy * xz * a * x AS all3, w0 / (a * x) AS f0, CASE WHEN w1 > xy AND a * y > xy THEN (w1 - xy) / greatest(a * y - xy, 1) ELSE 0 END AS f1,
CASE WHEN w2 > xz + yz AND a * z > xz + yz THEN (w2 - xz - yz) / greatest(a * z - xz - yz, 1) ELSE 0 END AS f2, CASE WHEN w2 > xz AND a * z > xz THEN (w2 - xz) / greatest(a * z - xz, 1) ELSE 0 END AS g2 FROM t),
v AS (SELECT *, xy * (a * x * z - all3) AS p12, xz * (a * x * y - all3) AS p13, yz * (a * x * y - all3) AS p23 FROM u)
SELECT coalesce(sum((a * x * y * z - p12 - p13 - p23 - all3) * f0 * f1 * f2 + p12 * f0 * g2 + p13 * f0 * f1 + p23 * f0 * f1 + all3 * f0), 0) FROM v)"""
ZIGZAG = """(WITH t AS (SELECT a.size AS a, b.size AS b, c.size AS c, d.size AS d, e0.w AS w0, e1.w AS w1, e2.w AS w2, (a.bucket = c.bucket)::INT AS ac, (b.bucket = d.bucket)::INT AS bd
FROM se e0 JOIN se e1 ON e0.bd = e1.bd JOIN se e2 ON e1.bs = e2.bs JOIN sb a ON a.bucket = e0.bs JOIN sb b ON b.bucket = e0.bd JOIN sb c ON c.bucket = e1.bs JOIN sb d ON d.bucket = e2.bd WHERE e0.el = 4 AND e1.el = 4 AND e2.el = 4),
u AS (SELECT *, ac * bd * a * b AS all3, w0 / (a * b) AS f0, CASE WHEN w1 > ac AND c * b > ac THEN (w1 - ac) / greatest(c * b - ac, 1) ELSE 0 END AS f1,
CASE WHEN w2 > ac * bd + bd AND c * d > ac * bd + bd THEN (w2 - ac * bd - bd) / greatest(c * d - ac * bd - bd, 1) ELSE 0 END AS f2, CASE WHEN w2 > bd AND c * d > bd THEN (w2 - bd) / greatest(c * d - bd, 1) ELSE 0 END AS g2 FROM t),
v AS (SELECT *, ac * (a * b * d - all3) AS p01, bd * (a * b * c - all3) AS p12 FROM u)
SELECT coalesce(sum((a * b * c * d - p01 - p12 - all3) * f0 * f1 * f2 + p01 * f0 * g2 + p12 * f0 * f1 + all3 * f0), 0) FROM v)"""


def cs(p: Pattern, rate: float = 0.03, seed: int = 0) -> str:
    rs, least, tables, conditions, first = relations(p), {}, [], [], {}
    for r in rs:
        for a, _ in r.attrs:
            least[a] = min(least.get(a, 1.0), rate ** (1 / max(1, len({a for a, _ in r.attrs}))))
    for i, r in enumerate(rs):
        tables.append(f"edges e{i}")
        conditions.append(f"e{i}.el = {r.table[1]}")
        for a, c in r.attrs:
            at = f"e{i}.{('src', 'dst')[c]}"
            s1, s2 = (2862933555777941757 + 3037000493 * (seed * 131 + a)) % (1 << 62) | 1, (1442695040888963407 * (a + 1) + seed) % (1 << 62)
            conditions.append(f"((({s1}::HUGEINT * {at} + {s2}) % {1 << 64}::HUGEINT) % {(1 << 61) - 1}::HUGEINT)::DOUBLE / {(1 << 61) - 1}::DOUBLE < {least[a]!r}")
            conditions += [f"{first[a]} = {at}"] if a in first else []
            first.setdefault(a, at)
    scale = 1.0
    for x in least.values():
        scale *= x
    return f"(SELECT count(*)::DOUBLE / {scale!r} FROM {', '.join(tables)} WHERE {' AND '.join(conditions)})"


#: Edges by position: in their label, at their source and at their target, with the counts of each.
PLACES = """, es AS (SELECT el, src, dst, row_number() OVER (PARTITION BY el ORDER BY src, dst) - 1 AS i, row_number() OVER (PARTITION BY el, src ORDER BY dst) - 1 AS i_src, row_number() OVER (PARTITION BY el, dst ORDER BY src) - 1 AS i_dst,
count(*) OVER (PARTITION BY el) AS n, count(*) OVER (PARTITION BY el, src) AS n_src, count(*) OVER (PARTITION BY el, dst) AS n_dst FROM edges)"""
#: Orders of the edges, worked out by hand: all of them for wj; for jsub the trees, each with how its start is extended.
ORDERS = {"chain3": [(0, 1, 2), (1, 0, 2), (2, 1, 0), (1, 2, 0)], "wedge_in": [(0, 1), (1, 0)]}
_DOWN = "(SELECT src, count(*) AS k FROM edges WHERE el = 0 GROUP BY src)"
_UP = "(SELECT dst, count(*) AS k FROM edges WHERE el = 3 GROUP BY dst)"
TREES = {
    "chain3": [
        ((0, 1, 2), f"SELECT e.dst AS x, sum(d.k) AS w FROM (SELECT src AS dst, dst AS n FROM edges WHERE el = 1) e JOIN {_DOWN} d ON e.n = d.src GROUP BY e.dst", "s.dst = t.x"),
        ((1, 0, 2), f"SELECT a.dst AS x, d.src AS y, a.k * d.k AS w FROM edges b JOIN {_UP} a ON b.src = a.dst JOIN {_DOWN} d ON b.dst = d.src WHERE b.el = 1", "s.src = t.x AND s.dst = t.y"),
        ((2, 1, 0), f"SELECT b.dst AS x, sum(a.k) AS w FROM edges b JOIN {_UP} a ON b.src = a.dst WHERE b.el = 1 GROUP BY b.dst", "s.src = t.x"),
    ],
    "triangle": [((i, j), f"SELECT {own} AS x, count(*) AS w FROM edges WHERE el = {el} GROUP BY {own}", f"s.{at} = t.x") for i, j, at, el, own in ((0, 1, "dst", 6, "src"), (1, 0, "src", 4, "dst"), (2, 0, "src", 4, "src"), (0, 2, "src", 5, "src"), (1, 2, "dst", 5, "dst"), (2, 1, "dst", 6, "dst"))],
    "wedge_in": [((i, j), f"SELECT dst AS x, count(*) AS w FROM edges WHERE el = {el} GROUP BY dst", "s.dst = t.x") for i, j, el in ((0, 1, 2), (1, 0, 1))],
}
_P31 = (1 << 31) - 1


def draw(walk: str, step: int, seed: str, n: str) -> str:
    a, b = f"((({seed} * 7919 + {step * 104729 + 48271}) % {_P31}) | 1)", f"(({seed} * 15485863 + {step * 32452843 + 11}) % {_P31})"
    return f"(((({walk} % {_P31} * {a} + {b}) % {_P31}) * 16807 + {step}) % {_P31}) % {n}"


def walked(p: Pattern, order: tuple[int, ...], walks: str) -> str:
    """(seed, walk, inv, looks) of ``walks`` (seed, walk) along an order of a pattern without labels, bounds and cycles."""
    at, joins, inv, looks = {}, [], [], ["1"]
    for k, i in enumerate(order):
        e = p.edges[i]
        if k == 0:
            joins.append(f"LEFT JOIN es s0 ON s0.el = {e.el} AND s0.i = {draw('w.walk', 0, 'w.seed', f'(SELECT count(*) FROM edges WHERE el = {e.el})')}")
            inv.append("s0.n")
        else:
            v, c = next((v, c) for v, c in ((e.src, "src"), (e.dst, "dst")) if v in at)
            joins.append(f"LEFT JOIN (SELECT DISTINCT {c}, n_{c} FROM es WHERE el = {e.el}) d{k} ON d{k}.{c} = {at[v]} LEFT JOIN es s{k} ON s{k}.el = {e.el} AND s{k}.{c} = {at[v]} AND s{k}.i_{c} = {draw('w.walk', k, 'w.seed', f'd{k}.n_{c}')}")
            inv.append(f"s{k}.n_{c}")
        if k + 1 < len(order):
            looks.append(f"(s{k}.el IS NOT NULL)::INT")
        for v, c in ((e.src, "src"), (e.dst, "dst")):
            at.setdefault(v, f"s{k}.{c}")
    return f"SELECT w.seed, w.walk, coalesce({' * '.join(f'{x}::DOUBLE' for x in inv)}, 0) AS inv, {' + '.join(looks)} AS looks FROM {walks} w {' '.join(joins)}"


def _budget(p: Pattern, rate: float) -> str:
    sizes = " + ".join(f"(SELECT count(*) FROM edges WHERE el = {e.el})" for e in p.edges)
    return f"floor((({sizes}) // {len(p.edges)}) * {rate!r})::BIGINT"


def wj(p: Pattern, name: str, rate: float = 0.03, seeds: tuple[int, ...] = (0,), enough: int = 100) -> str:
    """(seed, est), by all walks along all orders."""
    orders = ORDERS[name]
    all_walks = " UNION ALL ".join(f"SELECT {k} AS plan, x.* FROM ({walked(p, order, 'w')}) x" for k, order in enumerate(orders))
    return f"""(WITH b AS (SELECT {_budget(p, rate)} AS n), w AS (SELECT seed, walk FROM (SELECT unnest({list(seeds)}) AS seed) s, (SELECT unnest(range(0, (SELECT n FROM b))) AS walk) k),
r AS ({all_walks}), rr AS (SELECT * FROM r WHERE walk % {len(orders)} = plan),
f AS (SELECT seed, min(walk) + 1 AS t FROM (SELECT seed, walk, row_number() OVER (PARTITION BY seed, plan ORDER BY walk) AS k FROM rr WHERE inv > 0) x WHERE k = {enough} GROUP BY seed),
t AS (SELECT s.seed, coalesce(f.t, (SELECT n FROM b)) AS t FROM (SELECT unnest({list(seeds)}) AS seed) s LEFT JOIN f ON f.seed = s.seed),
c AS (SELECT rr.seed, plan, var_samp(inv) * avg(looks) AS cost FROM rr JOIN t ON rr.seed = t.seed AND walk < t GROUP BY rr.seed, plan HAVING count(*) FILTER (inv > 0) >= {enough / 2}),
best AS (SELECT seed, min_by(plan, (cost, plan)) AS plan FROM c GROUP BY seed),
kept AS (SELECT rr.seed, inv FROM rr JOIN t ON rr.seed = t.seed AND walk < t UNION ALL SELECT r.seed, inv FROM r JOIN t ON r.seed = t.seed AND walk >= t JOIN best ON best.seed = r.seed AND best.plan = r.plan)
SELECT t.seed, coalesce(sum(inv), 0) / (SELECT greatest(n, 1) FROM b) AS est FROM t LEFT JOIN kept ON t.seed = kept.seed GROUP BY t.seed)"""


def jsub(p: Pattern, name: str, rate: float = 0.03, seeds: tuple[int, ...] = (0,)) -> str:
    """(seed, est): the tree by its trial walk, then the weights of its drawn starts."""
    trees = TREES[name]
    tried = " UNION ALL ".join(f"SELECT {k} AS plan, x.* FROM ({walked(p, order, 'w')}) x WHERE walk = {k}" for k, (order, _, _) in enumerate(trees))
    found = " UNION ALL ".join(
        f"SELECT {k} AS plan, w.seed, coalesce(sum(t.w), 0) * max(size) AS total FROM (SELECT seed, size, {draw('walk', len(order), 'seed', 'size')} AS i FROM (SELECT seed, unnest(range(0, (SELECT n FROM b))) AS walk FROM seeds) y, (SELECT count(*) AS size FROM edges WHERE el = {el}) z) w JOIN (SELECT * FROM es WHERE el = {el}) s ON s.i = w.i LEFT JOIN ({weight}) t ON {on} GROUP BY w.seed"
        for k, (order, weight, on) in enumerate(trees)
        for el in (p.edges[order[0]].el,)
    )
    return f"""(WITH b AS (SELECT {_budget(p, rate)} AS n), seeds AS (SELECT unnest({list(seeds)}) AS seed), w AS (SELECT seed, unnest(range(0, {len(trees)})) AS walk FROM seeds), tried AS ({tried}),
chosen AS (SELECT s.seed, coalesce(min_by(plan, (inv, plan)) FILTER (inv > 0), 0) AS plan FROM seeds s LEFT JOIN tried ON s.seed = tried.seed GROUP BY s.seed), found AS ({found})
SELECT c.seed, coalesce(total, 0)::DOUBLE / (SELECT greatest(n, 1) FROM b) AS est FROM chosen c LEFT JOIN found ON c.seed = found.seed AND c.plan = found.plan)"""


#: What a window counts, worked out by hand: (path, left out vertex's choices) as SQL over x0.., l1.., o1.. of a window; and the number of paths.
WINDOWS = {
    "wedge_in": ("CASE WHEN l1 = 1 THEN (SELECT count(*) FROM edges WHERE el = 2 AND dst = CASE WHEN o1 THEN x1 ELSE x0 END) ELSE (SELECT count(*) FROM edges WHERE el = 1 AND dst = CASE WHEN o1 THEN x1 ELSE x0 END) END", "1", 4),
    "chain3": (
        """CASE WHEN l1 = 3 AND o1 AND l2 = 1 AND o2 THEN (SELECT count(*) FROM edges WHERE el = 0 AND src = x2) WHEN l1 = 1 AND NOT o1 AND l2 = 3 AND NOT o2 THEN (SELECT count(*) FROM edges WHERE el = 0 AND src = x0)
WHEN l1 = 1 AND o1 AND l2 = 0 AND o2 THEN (SELECT count(*) FROM edges WHERE el = 3 AND dst = x0) WHEN l1 = 0 AND NOT o1 AND l2 = 1 AND NOT o2 THEN (SELECT count(*) FROM edges WHERE el = 3 AND dst = x2) ELSE 0 END""",
        "d1",  # the ends of two steps are never joined here, so all orders pass the middle
        4,
    ),
}


def impr(p: Pattern, name: str, rate: float = 0.03, seeds: tuple[int, ...] = (0,), slides: int = 4) -> str:
    """(seed, est), by the windows of all walks."""
    count, inverse, paths = WINDOWS[name]
    n, els = len(p.vertices), ", ".join(str(e.el) for e in p.edges)
    steps = n - 2 + slides - 1
    joins, columns = "", ["h0.vid AS x0", "h0.other AS x1", "h0.el AS l1", "h0.out AS o1", "NULL::BIGINT AS d0"]
    for k in range(2, steps + 1):
        joins += f" JOIN dg d{k} ON d{k}.vid = {'h0' if k == 2 else f'h{k - 1}'}.other JOIN half h{k} ON h{k}.vid = d{k}.vid AND h{k}.r = {draw('w.walk', k, 'w.seed', f'd{k}.deg')}"
        columns += [f"h{k}.other AS x{k}", f"h{k}.el AS l{k}", f"h{k}.out AS o{k}", f"d{k}.deg AS d{k - 1}"]
    first = joins.replace("h1.", "h0.")
    windows = " UNION ALL ".join(
        f"SELECT seed, {', '.join([f'x{j + k} AS x{k}' for k in range(n - 1)] + [f'{c}{j + k} AS {c}{k}' for c in 'lo' for k in range(1, n - 1)] + [f'd{j + k} AS d{k}' for k in range(1, n - 2)])} FROM walked" for j in range(slides)
    )
    return f"""(WITH seeds AS (SELECT unnest({list(seeds)}) AS seed), own AS (SELECT * FROM edges WHERE el IN ({els})), b AS (SELECT floor((SELECT count(*) FROM own) * {rate!r})::BIGINT // {n + slides - 1} AS n, 2 * (SELECT count(*) FROM own) AS total),
half AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY el, out DESC, other) - 1 AS r, row_number() OVER (ORDER BY el, CASE WHEN out THEN vid ELSE other END, CASE WHEN out THEN other ELSE vid END, out DESC) - 1 AS pos FROM (SELECT src AS vid, el, true AS out, dst AS other FROM own UNION ALL SELECT dst, el, false, src FROM own) x),
dg AS (SELECT vid, count(*) AS deg FROM half GROUP BY vid), w AS (SELECT seed, walk, {draw('walk', 0, 'seed', 'total')} AS pos FROM (SELECT seed, unnest(range(0, (SELECT n FROM b))) AS walk FROM seeds) y, b),
walked AS (SELECT w.seed, {', '.join(columns)} FROM w JOIN half h0 ON h0.pos = w.pos{first}), v AS ({windows}), f AS (SELECT seed, (SELECT total FROM b) * {inverse} * ({count}) AS x FROM v)
SELECT s.seed, coalesce(sum(x), 0) / (SELECT greatest(n, 1) FROM b) / {paths * slides} AS est FROM seeds s LEFT JOIN f ON s.seed = f.seed GROUP BY s.seed)"""


def digits9(x: str) -> str:
    """A double cut to nine digits, so that the order of a sum does not show."""
    return f"format('{{:.9g}}', ({x})::DOUBLE)::DOUBLE"
