import itertools
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from graphtally.operators import bound_sketch, charsets, exact, random_walk, sampling, typed_summary
from graphtally.operators import walks as walks_
from graphtally.operators.graph import Graph
from graphtally.plans import cli
from graphtally.plans.costs import Watch
from graphtally.plans.harness import cost_report, error_lines, qerror_report, qerrors, result_lines, run_trials, trial_stats
from graphtally.plans.pattern import Pattern, relations
from graphtally.plans.queries import PATTERNS, QUERIES
from graphtally.plans.store import Store
from graphtally.sources import text
from graphtally.sources.star import star_graph


def graph(spark, n, labels, edges):
    return Graph(spark.createDataFrame([(i,) for i in range(n)], "vid long"), spark.createDataFrame(labels, "vid long, vl int"), spark.createDataFrame(edges, "src long, dst long, el int").distinct())


@pytest.fixture(scope="module")
def toy(spark):
    return graph(spark, 5, [(i, 0) for i in range(5)], [(2, 3, 0), (2, 1, 0), (1, 0, 0), (2, 4, 0)])


TOY = Pattern.of([(0, 1, 0), (1, 2, 0)], {0: 0, 1: 0, 2: 0})


def test_toy_values(toy):
    assert exact.count(toy, TOY).head()[0] == 1
    assert [bound_sketch.BoundSketch(b).estimate(toy, TOY) for b in (1, 4, 16, 64)] == [4, 1, 1, 1]
    assert len(bound_sketch.formulae(TOY)) == 12
    assert bound_sketch.hash_sizes(4096) == [1, 2, 3, 4, 5, 8, 16, 64, 4096]
    assert charsets.CharacteristicSets().estimate(toy, TOY) == pytest.approx(0.45)
    assert typed_summary.TypedSummary().estimate(toy, TOY) == pytest.approx(1.0)
    assert sampling.CorrelatedSampling(1.0).estimate(toy, TOY) == 1
    assert sampling.WanderJoin().estimate(toy, TOY) == 0 == sampling.JSub().estimate(toy, TOY)
    assert sampling.JSub(full=True).estimate(toy, TOY) == 1


def test_against_enumeration(spark):
    r = random.Random(5)
    edges = sorted({(r.randrange(6), r.randrange(6), r.randrange(2)) for _ in range(22)})
    labels = [(i, i % 2) for i in range(6)]
    g = graph(spark, 6, labels, edges)
    patterns = [Pattern.of([(0, 1, 0), (1, 2, 1), (0, 2, 0)]), Pattern.of([(0, 1, 0), (0, 2, 1)], {1: 1}), Pattern.of([(0, 0, 0), (0, 1, 1)]), Pattern.of([(0, 1, 0), (2, 3, 1), (3, 4, 0)]), Pattern.of([(0, 1, 0), (1, 2, 1)], bounds={2: 3})]
    for p in patterns:
        want = 0
        for m in itertools.product(range(6), repeat=len(p.vertices)):
            want += all((m[e.src], m[e.dst], e.el) in edges for e in p.edges) and all((v.bound is None or m[v.id] == v.bound) and (v.label is None or (m[v.id], v.label) in labels) for v in p.vertices)
        assert exact.count(g, p).head()[0] == want
        assert sampling.CorrelatedSampling(1.0).estimate(g, p) == want
    assert bound_sketch.BoundSketch(9).estimate(g, patterns[0]) >= exact.count(g, patterns[0]).head()[0]
    assert sampling.JSub(full=True).estimate(g, patterns[1]) == exact.count(g, patterns[1]).head()[0]


def test_bound_holds(spark):
    """No formula lies below the count, whatever the pattern, the budget or the rule for cutting; relations that cover nothing count by their degree."""
    r = random.Random(6)
    edges = sorted({(r.randrange(9), r.randrange(9), r.randrange(2)) for _ in range(60)})
    g = graph(spark, 9, [(i, i % 2) for i in range(9)], edges)
    shapes = [[(0, 1), (1, 2), (2, 3)], [(0, 1), (0, 2), (0, 3)], [(0, 1), (1, 2), (0, 2)], [(0, 1), (1, 2), (3, 2), (0, 3)], [(0, 1), (2, 1)], [(0, 1), (2, 3)], [(0, 0), (0, 1), (1, 2)]]
    ps = [Pattern.of([(a, b, r.randrange(2)) for a, b in x], {0: 1} if k % 2 else {}) for k, x in enumerate(shapes)]
    wants = [exact.count(g, p).head()[0] for p in ps]
    for m in (bound_sketch.BoundSketch(1), bound_sketch.BoundSketch(30), bound_sketch.BoundSketch(30, tight=True)):
        held = m.summarize(g, Store.scratch(spark))
        for p, want in zip(ps, wants, strict=True):
            assert m.estimate(g, p, 0, held) >= want
    p = Pattern.of([(0, 1, 0), (1, 2, 1)], bounds={2: edges[0][1]})
    assert bound_sketch.BoundSketch(30, bounds="apply").estimate(g, p) >= exact.count(g, p).head()[0]


def test_cut_attributes():
    p = Pattern.of([(0, 1, 4), (1, 2, 6), (0, 2, 5)])
    rs = relations(p)
    assert bound_sketch.cut_attributes(rs, [0], {1: 1}) == [0, 1]  # 0 is held by the relation that is left out
    assert bound_sketch.cut_attributes(rs, [0], {1: 1}, tight=True) == [1]


def test_wander_join_mean(spark):
    g = graph(spark, 40, [], [(i, 20 + (i * k) % 20, 0) for i in range(20) for k in (1, 3, 7)] + [(20 + i, (i * 5 + k) % 20, 1) for i in range(20) for k in range(1 + i % 3)])
    p = Pattern.of([(0, 1, 0), (1, 2, 1)])
    assert sampling.WanderJoin(60.0).estimate(g, p, 3) == pytest.approx(exact.count(g, p).head()[0], rel=0.15)


def test_wander_join_from_labels(spark):
    """Orders may start at a labelled vertex; every order alone has the exact count as its mean."""
    r = random.Random(8)
    edges = sorted({(r.randrange(20), r.randrange(20), r.randrange(2)) for _ in range(160)})
    g = graph(spark, 20, [(i, i % 3) for i in range(20)], edges)
    p = Pattern.of([(0, 1, 0), (1, 2, 1)], {0: 1, 1: 2})
    plans = list(sampling.walk_plans(p, 12, labels=True))
    assert plans == [[0, 1], [1, 0], [-1, 0, 1], [-2, 0, 1], [-2, 1, 0]] and list(sampling.walk_plans(p, 12)) == [[0, 1], [1, 0]]
    want = exact.count(g, p).head()[0]
    held, walks = walks_.index(g, Store.scratch(spark)), spark.range(20000 * len(plans)).selectExpr("7 AS seed", "id div 5 AS walk", "CAST(id % 5 AS INT) AS plan")
    last = walks_.walk(held, g, p, plans, walks, Store.scratch(spark))[-1]
    means = {x["plan"]: x["s"] / 20000 for x in last.groupBy("plan").agg({"inv": "sum"}).withColumnRenamed("sum(inv)", "s").collect()}
    assert means == {k: pytest.approx(want, rel=0.15) for k in range(5)}
    wj = sampling.WanderJoin(60.0)
    assert wj.estimate(g, p, 2) == pytest.approx(want, rel=0.2)


def plain_draw(walk, step, seed, n):
    p31 = (1 << 31) - 1
    a, b = (seed * 7919 + step * 104729 + 48271) % p31 | 1, (seed * 15485863 + step * 32452843 + 11) % p31
    return ((walk % p31 * a + b) % p31 * 16807 + step) % p31 % n


def plain_walk(edges, labels, p, order, walk, seed):
    """(inverse probability or None, look-ups) of a walk, by the definition."""
    at, inv, looks = {}, 1.0, 0
    for step, i in enumerate(order):
        looks += 1
        fresh = []
        if i < 0:
            own = sorted(v for v, vl in labels if vl == p.vertices[-1 - i].label)
            at[-1 - i] = own[plain_draw(walk, step, seed, len(own))]
            inv *= len(own)
            if p.vertices[-1 - i].bound not in (None, at[-1 - i]):
                return None, looks
            continue
        e = p.edges[i]
        if not at:
            own = sorted((a, b) for a, b, el in edges if el == e.el)
            a, b = own[plain_draw(walk, step, seed, len(own))]
            inv *= len(own)
            if e.src == e.dst and a != b:
                return None, looks
            at[e.src], at[e.dst] = a, b
            fresh = [e.src, e.dst]
        elif e.src in at and e.dst in at:
            if (at[e.src], at[e.dst], e.el) not in edges:
                return None, looks
        else:
            here, there = (e.src, e.dst) if e.src in at else (e.dst, e.src)
            own = sorted(b if here == e.src else a for a, b, el in edges if el == e.el and at[here] == (a if here == e.src else b))
            if not own:
                return None, looks
            at[there] = own[plain_draw(walk, step, seed, len(own))]
            inv *= len(own)
            fresh = [there]
        for v in fresh:
            if p.vertices[v].bound not in (None, at[v]) or p.vertices[v].label is not None and (at[v], p.vertices[v].label) not in labels:
                return None, looks
    return inv, looks


def plain_wander(edges, labels, p, plans, n, seed, enough):
    seen, total, chosen = [[] for _ in plans], 0.0, 0 if len(plans) == 1 else None
    for i in range(n):
        k = i % len(plans) if chosen is None else chosen
        inv, looks = plain_walk(edges, labels, p, plans[k], i, seed)
        total += inv or 0.0
        if chosen is None:
            seen[k].append((inv or 0.0, looks))
            if sum(x > 0 for x, _ in seen[k]) == enough:
                costs = []
                for j, own in enumerate(seen):
                    if sum(x > 0 for x, _ in own) >= enough / 2:
                        mean = sum(x for x, _ in own) / len(own)
                        costs.append((sum((x - mean) ** 2 for x, _ in own) / max(1, len(own) - 1) * sum(y for _, y in own) / len(own), j))
                chosen = min(costs)[1]
    return total / n


def test_trials_are_data(spark):
    """All trials of a run in one job, each as a plain walk by walk version has it, whatever the rounds; plans are not capped."""
    r = random.Random(4)
    edges = {(r.randrange(14), r.randrange(14), r.randrange(2)) for _ in range(150)}
    labels = {(i, i % 2) for i in range(14)}
    g = graph(spark, 14, sorted(labels), sorted(edges))
    triangle, star = Pattern.of([(0, 1, 0), (1, 2, 1), (0, 2, 0)], {1: 1}), Pattern.of([(0, i, i % 2) for i in range(1, 5)], bounds={1: min(edges)[1]})
    held = sampling.WanderJoin().summarize(g, Store.scratch(spark))
    for p, rate, seeds in ((triangle, 6.0, [0, 1, 5]), (star, 2.0, [3])):
        n = sampling.budget(g, p, rate)
        plans = list(sampling.walk_plans(p, n, labels=True))
        assert len(plans) == (10 if p is triangle else 24)
        want = {s: plain_wander(edges, labels, p, plans, n, s, 6) for s in seeds}
        assert len(set(want.values())) == len(seeds) and all(want.values())
        for trial in (8,) if p is triangle else (128,):
            got = {x["seed"]: x["est"] for x in sampling.WanderJoin(rate, trial, 6).trials(g, p, seeds, held).collect()}
            assert got == {s: pytest.approx(x) for s, x in want.items()}
    t = run_trials(spark, g, {"triangle": triangle}, [sampling.WanderJoin(6.0, 128, 6)], 2, summaries={"wj": held})
    assert {x["seed"]: x["est"] for x in t.collect()} == {s: pytest.approx(plain_wander(edges, labels, triangle, list(sampling.walk_plans(triangle, 10**6, labels=True)), sampling.budget(g, triangle, 6.0), s, 6)) for s in (0, 1)}


def plain_jsub(edges, labels, p, n, seed):
    trees = sampling.tree_plans(p, n)
    tried = [(inv, k) for k, order in enumerate(trees) if (inv := plain_walk(edges, labels, p, order, k, seed)[0]) is not None]
    order = trees[min(tried, default=(0, 0))[1] if len(trees) > 1 else 0]
    own = sorted((a, b) for a, b, el in edges if el == p.edges[order[0]].el)

    def extend(at, rest):
        if not rest:
            return 1
        e, total = p.edges[rest[0]], 0
        for a, b, el in edges:
            if el == e.el and all(at.get(v, x) == x and (p.vertices[v].label is None or (x, p.vertices[v].label) in labels) for v, x in ((e.src, a), (e.dst, b))):
                total += extend(at | {e.src: a, e.dst: b}, rest[1:])
        return total

    total = 0
    for i in range(n):
        a, b = own[plain_draw(i, len(order), seed, len(own))]
        e = p.edges[order[0]]
        if all(p.vertices[v].label is None or (x, p.vertices[v].label) in labels for v, x in ((e.src, a), (e.dst, b))):
            total += extend({e.src: a, e.dst: b}, order[1:])
    return total * len(own) / n


def test_drawn_starts(spark):
    """Weights of drawn starts only, as a plain version has them; their mean is the acyclic part's count."""
    r = random.Random(14)
    edges = {(r.randrange(12), r.randrange(12), r.randrange(2)) for _ in range(90)}
    labels = {(i, i % 2) for i in range(12)}
    g = graph(spark, 12, sorted(labels), sorted(edges))
    held = sampling.JSub().summarize(g, Store.scratch(spark))
    for p in (Pattern.of([(0, 1, 0), (1, 2, 1)], {0: 1}), Pattern.of([(0, 1, 0), (1, 2, 1), (0, 2, 0)])):
        n = sampling.budget(g, p, 0.4)
        got = {x["seed"]: x["est"] for x in sampling.JSub(0.4).trials(g, p, [0, 2, 9], held).collect()}
        assert got == {s: pytest.approx(plain_jsub(edges, labels, p, n, s)) for s in (0, 2, 9)} and all(got.values())
    p = Pattern.of([(0, 1, 0), (1, 2, 1)])
    ests = [x["est"] for x in sampling.JSub(1.0).trials(g, p, list(range(12)), held).collect()]
    assert sum(ests) / 12 == pytest.approx(exact.count(g, p).head()[0], rel=0.1)


def test_starts_drawn_again_and_again(spark, monkeypatch):
    """More draws than edges: a row a trial and edge, and the same weights."""
    edges = {(0, 1, 0), (2, 1, 0), (3, 4, 0)} | {(1, i, 1) for i in range(5, 9)}
    g, rows, save = graph(spark, 9, [], sorted(edges)), {}, Store.save
    monkeypatch.setattr(Store, "save", lambda self, name, df, by=None: rows.setdefault((self.path, name), save(self, name, df, by)))
    held = sampling.JSub().summarize(g, Store.scratch(spark))
    for p in (Pattern.of([(0, 1, 0)]), Pattern.of([(0, 1, 0), (1, 2, 1)])):
        rows.clear()
        n = sampling.budget(g, p, 40.0)
        got = {x["seed"]: x["est"] for x in sampling.JSub(40.0).trials(g, p, [0, 1, 5], held).collect()}
        assert got == {s: pytest.approx(plain_jsub(edges, set(), p, n, s)) for s in (0, 1, 5)} and all(got.values())
        assert n > 100 and 0 < sum(df.count() for (_, name), df in rows.items() if name == "starts") <= 4 * 3


def test_starts_are_not_broadcast(spark):
    """Starts of few bytes and many rows stay where they lie; what extends them goes to them."""
    g, store = graph(spark, 400, [], [(i, j, 1) for i in range(10) for j in range(10, 400)]), Store.scratch(spark)
    starts = store.save("drawn", spark.range(0, 60000, 1, 1).select(F.lit(0).alias("seed"), F.lit(1).cast("long").alias("k"), F.lit(7).cast("long").alias("v0"), F.floor(F.col("id") / 5000).alias("v1")))
    weights = sampling.sampled_completions(g, Pattern.of([(0, 1, 0), (1, 2, 1)]), [0, 1], starts, store)
    assert weights.agg(F.sum("w")).head()[0] == 50000 * 390
    assert "BuildLeft" not in weights._jdf.queryExecution().executedPlan().toString()


def test_failed_trial_says_why(spark, monkeypatch):
    def fail(*_):
        raise ValueError("no such walk")

    monkeypatch.setattr(sampling.JSub, "trials", fail)
    with pytest.raises(RuntimeError, match="no such walk"):
        QUERIES["jsub_trials"](spark, "/root/testdata/sf0.001")


def test_partitions(spark):
    assert len(typed_summary.partitions([0] * 7)) == 877
    assert typed_summary.partitions(list(range(9))) == [tuple(range(9))]
    assert sorted(typed_summary.partitions([0, 1, 0])) == [(0, 1, 0), (0, 1, 2)]
    g = graph(spark, 9, [], [(i, i + 1, i) for i in range(8)])
    assert typed_summary.TypedSummary().estimate(g, Pattern.of([(i, i + 1, i) for i in range(8)])) == pytest.approx(1.0)


def plain_typed_estimate(p, bucket, weight, edge):
    """The expected matches by recursion over all partitions of the pattern's edges, one embedding at a time."""
    n, es, total = len(p.vertices), p.edges, 0.0

    def coarser(x, y):
        return x != y and all(x[i] == x[j] for i in range(len(x)) for j in range(len(x)) if y[i] == y[j])

    def mgu(x):
        root = list(range(n))
        for i in range(len(x)):
            for j in range(i):
                if x[i] == x[j]:
                    if es[i].el != es[j].el:
                        return None
                    for a, b in ((es[i].src, es[j].src), (es[i].dst, es[j].dst)):
                        root = [root[a] if r == root[b] else r for r in root]
        seen = {(root[es[i].src], es[i].el, root[es[i].dst]): x[i] for i in range(len(x))}
        return root if len(seen) == len(set(x)) else None

    ways = {x: r for x in typed_summary.partitions([0] * len(es)) if (r := mgu(x)) is not None}
    for t in itertools.product(bucket, repeat=n):
        if any((t[e.src], e.el, t[e.dst]) not in edge for e in es):
            continue
        held = {x: r for x, r in ways.items() if all(t[v] == t[r[v]] for v in range(n))}

        def alone(x, t=t, held=held):
            solutions = 1.0
            for v in set(held[x]):
                solutions *= weight[t[v]]
            return solutions - sum(alone(y) for y in held if coarser(y, x))

        for x in held:
            chance, used = 1.0, {}
            for i in {x.index(k) for k in set(x)}:
                at = (t[es[i].src], es[i].el, t[es[i].dst])
                k = used[at] = used.get(at, -1) + 1
                cells = weight[at[0]] * weight[at[2]] - k
                chance *= (edge[at] - k) / cells if edge[at] > k and cells > 0 else 0.0
            total += alone(x) * chance
    return total


def test_repeated_labels(spark):
    """Patterns whose edges can fall on one, against recursion over all ways."""
    r = random.Random(8)
    edges = sorted({(r.randrange(8), r.randrange(8), r.randrange(2)) for _ in range(24)})
    g = graph(spark, 8, [(i, i % 2) for i in range(8)], edges)
    store = Store.scratch(spark)
    m = typed_summary.TypedSummary(least_target=1e9)
    held = m.summarize(g, store)
    weight = {x["bucket"]: x["w"] for x in held.table("bucket").collect()}
    edge = {(x["bs"], x["el"], x["bd"]): x["w"] for x in held.table("edge").collect()}
    for es in ([(0, 1, 0), (0, 2, 0), (0, 3, 0)], [(0, 1, 0), (2, 1, 0), (2, 3, 0)], [(0, 1, 0), (1, 2, 0), (2, 0, 0)], [(0, 1, 0), (0, 2, 1), (3, 1, 0), (3, 2, 1)], [(0, 0, 0), (0, 1, 0), (1, 1, 0)]):
        p = Pattern.of(es)
        assert m.estimate(g, p, 0, held) == pytest.approx(plain_typed_estimate(p, list(weight), weight, edge)), es


def test_reduced_embeddings(spark):
    """Rows without a partner go first: the same embeddings, tables that hold only what some embedding of the tree has."""
    r = random.Random(21)
    edges = sorted({(r.randrange(14), r.randrange(14), r.randrange(3)) for _ in range(40)})
    g = graph(spark, 14, [(i, i % 3) for i in range(14)], edges)
    m = typed_summary.TypedSummary(least_target=1e9)
    held = m.summarize(g, Store.scratch(spark))
    for p in (Pattern.of([(0, 1, 0), (1, 2, 1), (2, 3, 2), (0, 3, 1)], {0: 1}), Pattern.of([(0, 1, 0), (1, 1, 1), (2, 1, 2)])):
        rows = m.embeddings(held, g, p)
        less = typed_summary.TypedSummary(least_target=1e9, reduce_from=0)
        assert sorted(map(tuple, less.embeddings(held, g, p).select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
        assert less.estimate(g, p, 0, held) == pytest.approx(m.estimate(g, p, 0, held))
    p = Pattern.of([(0, 1, 0), (1, 2, 1), (2, 3, 2)])
    own = {i: m._edge_rows(held, p, i) for i in range(3)}
    everything = {v.id: held.table("bucket").select(typed_summary.F.col("bucket").alias(f"b{v.id}")) for v in p.vertices}
    tables, order = m._reduced(Store.scratch(spark), p, own, everything, [1, 0, 2])
    joined = own[0].join(own[1], "b1").join(own[2], "b2")
    for i in range(3):
        assert tables[i].count() == joined.select(*own[i].columns).distinct().count() <= own[i].count()
    assert sorted(order) == [0, 1, 2]


def test_many_edges_of_one_label(spark, toy):
    """Star of seven and eight equal edges: the terms stay few."""
    began = time.perf_counter()
    assert len(typed_summary.terms(Pattern.of([(0, i + 1, 0) for i in range(8)]), (0,) * 8)) < 70
    assert typed_summary.TypedSummary().estimate(toy, Pattern.of([(0, i + 1, 0) for i in range(7)])) > 0
    assert time.perf_counter() - began < 60


def test_experiments(spark, tmp_path):
    lines = cli.experiment("ratios", "g", "q", "o")
    assert len(lines) == 24 and lines[0] == ["-q", "-m", "wj", "-d", "g", "-i", "q", "-o", "o/ratios_wj_0.0001.txt", "-n", "30", "-p", "0.0001"]
    assert [len(cli.experiment(k, "g", "q", "o")) for k in cli.EXPERIMENTS] == [3, 7, 24, 25]
    (tmp_path / "g.txt").write_text("t # 1\nv 0 0\nv 1 0\nv 2 0\ne 0 1 0\ne 1 2 0\n")
    (tmp_path / "q.txt").write_text("t # s 1\nv 0 0 -1\nv 1 0 -1\ne 0 1 0\n")
    assert cli.main(["-x", "accuracy", "-d", str(tmp_path / "g.txt"), "-i", str(tmp_path / "q.txt"), "-o", str(tmp_path / "res"), "-n", "1"]) == 0
    assert len(list((tmp_path / "res").glob("accuracy_*.txt"))) == 7
    assert float((tmp_path / "res" / "accuracy_bsk.txt").read_text().split()[1]) == 2
    cli.main(["-b", "-m", "cset", "-d", str(tmp_path / "g.txt"), "-s", "5", "-o", str(tmp_path / "b.txt")])
    assert (tmp_path / "b.txt").read_text().startswith("cset ")


def test_random_walk(spark, toy):
    assert random_walk.RandomWalk().estimate(toy, TOY) == 0
    assert random_walk.RandomWalk().estimate(toy, Pattern.of([(i, i + 1, 0) for i in range(5)])) == -1
    assert random_walk.RandomWalk().estimate(toy, Pattern.of([(0, 1, 0), (2, 3, 0)])) == -1
    r = random.Random(5)
    edges = sorted({(r.randrange(12), r.randrange(12), r.randrange(2)) for _ in range(90)})
    g = graph(spark, 12, [(i, i % 2) for i in range(12)], edges)
    held = random_walk.RandomWalk().summarize(g, Store.scratch(spark))
    for p in (Pattern.of([(0, 1, 0)]), Pattern.of([(0, 1, 0), (1, 2, 1), (0, 2, 0)]), Pattern.of([(0, 1, 0), (0, 2, 1)], {1: 1}), Pattern.of([(0, 0, 0), (0, 1, 1)])):
        assert random_walk.RandomWalk(100.0).estimate(g, p, 1, held) == pytest.approx(exact.count(g, p).head()[0], rel=0.15)


def plain_impr(edges, labels, p, walks, slides, seed, orders):
    els, wide = sorted({e.el for e in p.edges}), len(p.vertices) - 2
    half = [h for el in els for a, b, _ in sorted(e for e in edges if e[2] == el) for h in ((a, b, el, True), (b, a, el, False))]
    around = {}
    for a, b, el, out in sorted(half, key=lambda h: (h[2], not h[3], h[1])):
        around.setdefault(a, []).append((b, el, out))
    paths, total = random_walk.open_paths(p), 0.0
    for w in range(walks):
        a, b, el, out = half[plain_draw(w, 0, seed, len(half))]
        x, s = [a, b], [(el, out)]
        for k in range(2, wide + slides):
            b, el, out = around[x[-1]][plain_draw(w, k, seed, len(around[x[-1]]))]
            x.append(b), s.append((el, out))
        for j in range(slides):
            at, steps = x[j : j + wide + 1], s[j : j + wide]
            chances = []
            for order in itertools.permutations(range(wide + 1)):
                ways, chance = 1, 1.0
                for a, b in itertools.pairwise(order):
                    ways *= sum(y == at[b] for y, _, _ in around[at[a]])
                for k in order[1:-1]:
                    chance /= len(around[at[k]])
                chances += [chance] * ways if orders or order == tuple(range(wide + 1)) else []
            found = 0
            for vs, way in paths:
                if all((p.edges[i].el, out) == got for (i, out), got in zip(way, steps, strict=True)):
                    left = next(v for v in range(len(p.vertices)) if v not in vs)
                    for y in {v for e in edges for v in e[:2]}:
                        m = dict(zip(vs, at, strict=True)) | {left: y}
                        found += all((m[e.src], m[e.dst], e.el) in edges for e in p.edges) and all((v.label is None or (m[v.id], v.label) in labels) and v.bound in (None, m[v.id]) for v in p.vertices)
            total += found * len(half) / (sum(chances) / len(chances))
    return total / (len(paths) * walks * slides)


def test_windows_of_walks(spark):
    """Every trial as a plain version has it, both weights; the window's own path is without bias where windows have further edges."""
    r = random.Random(15)
    edges = {(r.randrange(11), r.randrange(11), r.randrange(2)) for _ in range(60)}
    labels = {(i, i % 2) for i in range(11)}
    g = graph(spark, 11, sorted(labels), sorted(edges))
    held = random_walk.RandomWalk().summarize(g, Store.scratch(spark))
    p, seeds = Pattern.of([(0, 1, 0), (1, 2, 1), (3, 2, 0)], {3: 1}), [0, 4]
    n = int(1.0 * sum(g.stats["el"][e.el] for e in p.edges)) // (len(p.vertices) + 3 - 1)
    for orders in (True, False):
        got = {x["seed"]: x["est"] for x in random_walk.RandomWalk(1.0, 3, orders).trials(g, p, seeds, held).collect()}
        assert got == {s: pytest.approx(plain_impr(edges, labels, p, n, 3, s, orders)) for s in seeds} and all(got.values())
    ests = [x["est"] for x in random_walk.RandomWalk(20.0, 4, False).trials(g, p, list(range(6)), held).collect()]
    assert sum(ests) / 6 == pytest.approx(exact.count(g, p).head()[0], rel=0.1)


def test_pattern_parse_and_relations():
    p = Pattern.from_lines(["t # s 1", "v 0 -1 -1", "v 1 2 -1", "v 2 -1 5", "e 0 1 3", "e 1 2 4"])
    assert p.vertices[0].label is None and p.vertices[1].label == 2 and p.vertices[2].bound == 5
    rs = relations(p)
    assert [r.table for r in rs] == [("v", 2), ("e", 3), ("e", 4)]
    assert rs[1].attrs == [(1, 1)] and rs[2].bounds == {1: 5}
    with pytest.raises(ValueError):
        Pattern.of([(0, 1, 0)]).__class__((), Pattern.of([(0, 1, 0)]).edges)


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "g.txt").write_text("t # 1\nv 0 1 2\nv 1\nv 2 -1\ne 0 1 0 1\ne 0 1 0\ne 1 2 3\n")
    g = text.read_text(spark, str(tmp_path / "g.txt"))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 0), (0, 1, 1), (1, 2, 3)]
    assert sorted(map(tuple, g.vlabels.collect())) == [(0, 1), (0, 2)]
    assert text.read_text(spark, str(tmp_path / "g.txt"), dedup=False).edges.count() == 3
    assert [r[0] for r in text.text_lines(g).collect()] == ["v 0 1 2", "v 1", "v 2", "e 0 1 0", "e 0 1 1", "e 1 2 3"]
    text.write_parquet(g, str(tmp_path / "p"))
    assert text.read_parquet(spark, str(tmp_path / "p")).stats == g.stats


def test_harness(spark, toy):
    t = run_trials(spark, toy, {"toy": TOY}, [bound_sketch.BoundSketch(4), sampling.CorrelatedSampling(1.0)], 2)
    stats = {r["method"]: r for r in trial_stats(t).collect()}
    assert stats["bsk"]["ests"] == [1.0] and stats["cs"]["ests"] == [1.0, 1.0] and stats["cs"]["var_pop"] == 0
    errors = qerrors(t, spark.createDataFrame([("toy", 1)], "query string, matches long"))
    assert {r["method"]: r["p50"] for r in qerror_report(errors).collect()} == {"bsk": 1.0, "cs": 1.0}
    assert all(r["value"].startswith("toy 1.0") for r in result_lines(trial_stats(t)).collect())


def plain_refinement(labels, edges, n, ratio, threshold, least):
    """The refinement step by step on lists: bucket of each vertex, by its least vertex."""
    def wrap(x):
        return (x + (1 << 31)) % (1 << 32) - (1 << 31)

    own = {v: tuple(sorted(x for u, x in labels if u == v)) for v in range(n)}
    types = {v: (own[v], tuple(sorted({el for s, _, el in edges if s == v})), tuple(sorted({el for _, d, el in edges if d == v}))) for v in range(n)}
    first = {}
    for v in range(n):
        first.setdefault(types[v], v)
    numbers = {b: i for i, b in enumerate(first.values())}
    root = {i: i for i in numbers.values()}
    classes = {}
    for t, b in first.items():
        classes.setdefault(t[0], []).append(numbers[b])

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = {v: numbers[first[types[v]]] for v in range(n)}
    summary = {(at[s], el, at[d]) for s, d, el in edges}
    data = 4 * (n + 2 * len(edges) + len(labels))
    target, before = max((ratio * data - 4 * n) / 12, least), len(summary)
    ab, erased, now = typed_summary.scheme().tolist(), set(), before
    while before > target:
        for own_buckets in classes.values():
            sig = {}
            for b in own_buckets:
                pairs = [el * 127 + d for s, el, d in summary if s == b] + [s * 127 + el for s, el, d in summary if d == b]
                sig[b] = [min([wrap(wrap(p * 31) * x + y) for p in pairs], default=(1 << 31) - 1) for x, y in ab]
            for row in range(40):
                bins = {}
                for b in own_buckets:
                    if b not in erased:
                        h = wrap(31 * wrap(31 + sig[b][2 * row]) + sig[b][2 * row + 1])
                        bins.setdefault((h ^ ((h & 0xFFFFFFFF) >> 16)) & 32767, []).append(b)
                for lst in bins.values():
                    for b2 in lst[1:]:
                        if sum(x == y for x, y in zip(sig[lst[0]], sig[b2])) / 80 >= threshold:
                            erased.add(b2)
                            root[b2] = lst[0]
                            break
        summary = {(find(s), el, find(d)) for s, el, d in summary}
        now = len(summary)
        if now <= target or before - now < 1000:
            break
        before = now
    if now > target:
        alive = [b for b in root if root[b] == b]
        names = {numbers[b]: t[0] for t, b in first.items()}
        size = 4 * (2 * len(alive) + 3 * now + n + sum(len(names[b]) for b in alive))
        k = max(1, int(size / data / ratio))
        groups = list(classes.values())
        for t in range(0, len(groups), k):
            mine = sorted(b for x in groups[t : t + k] for b in x if b not in erased)
            for b in mine[1:]:
                root[b] = mine[0]
    back = {i: b for b, i in numbers.items()}
    return {v: back[find(at[v])] for v in range(n)}


@pytest.mark.parametrize(("ratio", "threshold", "least", "gather"), [(0.03, 0.15, 10, 1 << 16), (0.03, 0.9, 40, 1 << 16), (0.5, 0.3, 25, 1 << 16), (0.03, 0.15, 10000, 1 << 16), (0.03, 0.15, 10, 12)])
def test_refinement(spark, ratio, threshold, least, gather):
    r = random.Random(9)
    edges = sorted({(r.randrange(40), r.randrange(40), r.randrange(4)) for _ in range(90)})
    labels = [(v, v % 3) for v in range(40)]
    g = graph(spark, 40, labels, edges)
    held = typed_summary.TypedSummary(ratio, threshold, least, gather).summarize(g, Store.scratch(spark))
    want = plain_refinement(labels, edges, 40, ratio, threshold, least)
    assert {x["vid"]: x["bucket"] for x in held.table("member").collect()} == want
    count = {}
    for s, d, el in edges:
        count[want[s], el, want[d]] = count.get((want[s], el, want[d]), 0) + 1
    assert {(x["bs"], x["el"], x["bd"]): x["w"] for x in held.table("edge").collect()} == count
    for x in held.table("bucket").collect():
        own = [v for v in want if want[v] == x["bucket"]]
        assert x["w"] == len(own) and x["vls"] == sorted({v % 3 for v in own})
        assert x["outs"] == sorted({el for s, _, el in edges if s in own}) and x["ins"] == sorted({el for _, d, el in edges if d in own})
    if least == 10000:
        assert held.table("edge").count() == held.table("typed_edge").count()


def test_positions_and_cardinalities(spark):
    r = random.Random(3)
    edges = sorted({(r.randrange(9), r.randrange(9), r.randrange(3)) for _ in range(80)})
    g = graph(spark, 10, [(i, i % 2) for i in range(9)] + [(0, 5)], edges)
    by = {el: sorted((s, d) for s, d, x in edges if x == el) for el in range(3)}
    assert {(x["el"], x["i"]): (x["src"], x["dst"]) for x in g.ranked_edges().collect()} == {(el, i): e for el, own in by.items() for i, e in enumerate(own)}
    assert {(x["vl"], x["i"]): x["vid"] for x in g.ranked_vertices().collect()}[5, 0] == 0
    for x in g.ranked_adjacency(False).groupBy("vid", "el").agg({"i": "max", "deg": "max", "other": "count"}).collect():
        assert x["max(i)"] + 1 == x["max(deg)"] == x["count(other)"] == sum(d == x["vid"] and el == x["el"] for _, d, el in edges)
    assert {x["vid"]: x["n"] for x in g.vlabel_cardinality().collect()} == {v: (2 if v == 0 else 1 if v < 9 else 0) for v in range(10)}
    outs = {v: sorted({el for s, _, el in edges if s == v}) for v in range(10)}
    assert {x["vid"]: x["n"] for x in g.elabel_cardinality().collect()} == {v: len(outs[v]) for v in outs}
    assert {x["vid"]: x["i"] for x in g.elabel_ordinal(1).collect()} == {v: outs[v].index(1) if 1 in outs[v] else -1 for v in outs}
    steps = walks_.index(g, Store.scratch(spark)).table("steps").collect()
    assert {(x["out"], x["el"], x["vid"], x["i"]): x["other"] for x in steps} == {(out, el, v, i): w for out in (True, False) for el in range(3) for v in range(20) for i, w in enumerate(sorted((b if out else a) for a, b, x in edges if x == el and v == (a if out else b)))}


def test_join_order_and_trees():
    triangle = Pattern.of([(0, 1, 4), (1, 2, 6), (0, 2, 5)])
    stats = {"el": {4: 600, 5: 600, 6: 590}, "src": {4: 150, 5: 150, 6: 20}, "dst": {4: 20, 5: 10, 6: 10}, "vl": {}, "v": 200}
    assert set(triangle.join_order(stats)[:2]) == {0, 2}  # orders with few rows each, not suppliers with very many
    trees = sampling.tree_plans(triangle, 24)
    assert {(t[0], frozenset(t)) for t in trees} == {(s, frozenset((s, o))) for s in range(3) for o in range(3) if o != s}
    assert [t[0] for t in itertools.islice(sampling.walk_plans(Pattern.of([(0, i, 0) for i in range(1, 6)]), 5), 5)] == [0, 1, 2, 3, 4]


def test_summary_is_built_once(spark, toy, tmp_path):
    for m in (charsets.CharacteristicSets(), bound_sketch.BoundSketch(16), typed_summary.TypedSummary()):
        store = Store(spark, f"file://{tmp_path}/{m.name}")
        m.summarize(toy, store)
        size = store.size()
        m.summarize(toy, store)
        assert store.size() == size > 0
        assert m.estimate(toy, TOY, 0, Store(spark, store.path)) == pytest.approx(m.estimate(toy, TOY))
    assert bound_sketch.BoundSketch().formula_text(TOY, [0, 3], {4: 1}) == "count v0(x0) * count e0(x0,x1) * degree of x1 in e0(x1,x2)"


def test_timeout_and_errors(spark, toy):
    class Slow(sampling.CorrelatedSampling):
        name = "slow"

        def estimate(self, g, p, seed=0, summary=None):
            wait = udf(lambda x: time.sleep(20) or x, "long")
            return float(g.vertices.select(wait("vid")).count() + g.vertices.select(wait("vid")).agg({"<lambda>(vid)": "sum"}).head()[0])

    class Broken(sampling.CorrelatedSampling):
        name = "broken"

        def estimate(self, g, p, seed=0, summary=None):
            return g.vertices.select("nothing").count()

    t = run_trials(spark, toy, {"toy": TOY}, [Slow(), Broken()], 2, timeout=2.0)
    assert sorted((r["method"], r["status"]) for r in t.collect()) == [("broken", "error"), ("broken", "error"), ("slow", "timeout")]
    assert {r["value"] for r in error_lines(t).collect()} == {"toy 1", "toy 2"}


def test_command_line(spark, tmp_path):
    (tmp_path / "g.txt").write_text("t # 1\nv 0 0\nv 1 0\nv 2 0\nv 3 0\nv 4 0\ne 2 3 0\ne 2 1 0\ne 1 0 0\ne 2 4 0\n")
    (tmp_path / "queries" / "a").mkdir(parents=True)
    (tmp_path / "queries" / "a" / "toy.txt").write_text("t # s 1\nv 0 0 -1\nv 1 0 -1\nv 2 0 -1\ne 0 1 0\ne 1 2 0\n")
    data = str(tmp_path / "g.txt")
    assert cli.main(["-b", "-m", "bsk", "-d", data, "--budget", "16"]) == 0 and (tmp_path / "g.txt.bsk.b16" / "sketch" / "_SUCCESS").exists()
    for name, est in (("bsk", "1"), ("cset", "0.45")):
        cli.main(["-q", "-m", name, "-d", data, "-i", str(tmp_path / "queries"), "-o", str(tmp_path / "out.txt"), "--budget", "16"])
        one, two = (tmp_path / "out.txt").read_text().splitlines()
        assert one.startswith("a/toy.txt ") and float(one.split()[1]) == pytest.approx(float(est)) and two.split()[0] == "1"
        assert (tmp_path / "out.txt.err").read_text() == ""
    cli.main(["-q", "-m", "wj", "-d", f"file://{data}", "-i", f"file://{tmp_path}/queries", "-o", f"file://{tmp_path}/new/wj.txt", "-n", "2", "--costs", f"file://{tmp_path}/costs"])
    assert (tmp_path / "new" / "wj.txt").read_text().startswith("a/toy.txt ")
    (r,) = spark.read.parquet(str(tmp_path / "costs")).collect()
    assert (r["query"], r["method"], r["trials"]) == ("a/toy.txt", "wj", 2) and r["shuffle_kb"] >= 0 and r["cpu_ms"] > 0


def test_patterns_by_any_path(spark, tmp_path):
    """Names with odd characters, several depths, other endings, an empty folder, a single file."""
    (tmp_path / "q" / "a b#" / "c").mkdir(parents=True)
    (tmp_path / "none").mkdir()
    line = "v 0 0 -1\nv 1 0 -1\ne 0 1 {}\n"
    for i, name in enumerate(("z.txt", "a b#/é%20.txt", "a b#/c/d.txt", "a b#/c/e.csv")):
        (tmp_path / "q" / name).write_text(line.format(i))
    got = cli.patterns(spark, f"file://{tmp_path}/q/")
    assert {n: p.edges[0].el for n, p in got.items()} == {"z.txt": 0, "a b#/é%20.txt": 1, "a b#/c/d.txt": 2}
    assert list(got) == sorted(got)
    assert cli.patterns(spark, str(tmp_path / "none")) == {}
    assert {n: p.edges[0].el for n, p in cli.patterns(spark, str(tmp_path / "q" / "a b#" / "c" / "e.csv")).items()} == {"e.csv": 3}


def test_costs(spark, toy):
    """Only marked jobs count, a second watch starts anew, groups and tags are left as they were."""
    def work():
        return spark.range(0, 200000, 1, 4).selectExpr("id % 5000 as k").repartition(3, "k").groupBy("k").count().collect()

    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", "mine")
    with Watch(spark) as w:
        work()
    once = w.cost()
    work()
    assert w.cost() == once and once.stages >= 2 and once.cpu_ms > 0 and once.shuffle_kb > 0 and once.spill_kb == 0
    assert once.executor_kb is None or once.executor_kb > 0
    with Watch(spark) as nothing:
        pass
    assert (nothing.cost().stages, nothing.cost().executor_kb) == (0, None)
    assert not any(t.startswith("graphtally-") for t in spark.sparkContext.getJobTags())
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "mine"
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    t = run_trials(spark, toy, {"toy": TOY}, [sampling.CorrelatedSampling(1.0), sampling.WanderJoin(1.0)], 2)
    report = {r["method"]: r for r in cost_report(t).collect()}
    assert {m: r["trials"] for m, r in report.items()} == {"cs": 2, "wj": 2}
    assert all(r["cpu_ms"] > 0 and r["driver_kb"] > 0 and r["avg_ms"] > 0 for r in report.values())


def test_summaries_for_patterns(spark):
    g, p = star_graph(spark, "/root/testdata/sf0.001"), PATTERNS["triangle"]
    for m in (sampling.JSub(0.3),):
        whole, own = m.summarize(g, Store.scratch(spark)), m.summarize(g, Store.scratch(spark), [p])
        assert {r["el"] for r in own.table("starts").select("el").distinct().collect()} == {4, 5, 6}
        assert own.size() < whole.size()
        assert sorted(map(tuple, m.trials(g, p, [0], whole).collect())) == sorted(map(tuple, m.trials(g, p, [0], own).collect()))
    assert not sampling.JSub(0.3).summarize(g, Store.scratch(spark)).has("steps")  # a walk a tree needs no table of all neighbours


def test_sketches_for_patterns(spark):
    """Only the asked sketches are made, with the values of the whole table."""
    r = random.Random(5)
    edges = sorted({(r.randrange(40), r.randrange(40), r.randrange(3)) for _ in range(400)})
    g = graph(spark, 40, [(i, i % 2) for i in range(40)], edges)
    p, m = Pattern.of([(0, 1, 0), (1, 2, 1), (0, 2, 0)], {1: 1}), bound_sketch.BoundSketch(64)
    whole, own = (m.summarize(g, Store.scratch(spark), x) for x in (None, [p]))
    cells, few = ({tuple(x) for x in held.table("sketch").collect()} for held in (whole, own))
    assert few < cells and {(x[0], x[1]) for x in few} == {("e", 0), ("e", 1), ("v", 1)}
    assert m.estimate(g, p, 0, own) == m.estimate(g, p, 0, whole) >= exact.count(g, p).head()[0]


def test_types_of_repeated_edges(spark):
    """Types and label predicates need no distinct edges; labels beyond a long's bits give the same lists."""
    g = graph(spark, 5, [(0, 3), (0, 1), (1, 1)], [(0, 1, 7), (0, 2, 2), (3, 0, 2)])
    own = Graph(g.vertices, g.vlabels, g.edges.where("false"), repeated=g.edges.unionAll(g.edges))
    types = {r["vid"]: (r["vls"], r["outs"], r["ins"]) for r in own.vertex_types().collect()}
    assert types == {0: ([1, 3], [2, 7], [2]), 1: ([1], [], [7]), 2: ([], [], [2]), 3: ([], [2], []), 4: ([], [], [])}
    assert [r["vid"] for r in own.having_elabel(g.vertices, 2).sort("vid").collect()] == [0, 3]
    many = Graph(g.vertices, g.vlabels.unionAll(spark.createDataFrame([(4, k) for k in range(80)], "vid long, vl int")), g.edges)
    wide = {r["vid"]: (r["vls"], r["outs"], r["ins"]) for r in many.vertex_types().collect()}
    assert wide == types | {4: (list(range(80)), [], [])}


def test_lines_are_made_after_the_sort(toy):
    plan = text.text_lines(toy)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("concat_ws") < plan.index("Sort")


def test_tasks_grow_with_the_input(spark, monkeypatch):
    """Distinct edges and the pairs that an edge tests are dealt by rows, not by the session's number of partitions; no pair is summed before it is tested."""
    from graphtally.operators import graph as graph_

    p = PATTERNS["triangle"]
    want = exact.count(star_graph(spark, "/root/testdata/sf0.001"), p).head()[0]
    monkeypatch.setattr(graph_, "TASK_ROWS", 1000)
    monkeypatch.setattr(exact, "TASK_ROWS", 1000)
    g = star_graph(spark, "/root/testdata/sf0.001")
    assert g.of_label(4).rdd.getNumPartitions() >= 6  # 6000 rows
    counted = exact.count(g, p)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.count("partial_sum") == 1
    assert counted.head()[0] == want > 0


@pytest.mark.parametrize("out", [True, False])
def test_charsets_of_few_and_of_many_labels(spark, monkeypatch, out):
    """Labels as bits and columns give the sets of the general way: bare vertices, ends and labels of no vertex, repeated labels, any label numbers."""
    r = random.Random(9)
    edges = [(r.randrange(12), r.randrange(12), r.choice((3, 40, 70000))) for _ in range(60)] + [(99, 0, 3), (0, 99, 40)]
    g = graph(spark, 14, [(i, x) for i in range(10) for x in (7, 7, 64, 1000)[: i % 5]] + [(99, 7)], edges)

    def rows(df):
        return sorted((tuple(x.vls), tuple(x.els), x.n, tuple(map(tuple, x.freq))) for x in df.select("vls", "els", "n", "freq").collect())

    few = charsets.sets(g, out)
    assert "ObjectHashAggregate" not in few._jdf.queryExecution().executedPlan().toString()
    got = rows(few)
    monkeypatch.setattr(charsets, "COLUMNS", 0)
    assert got == rows(charsets.sets(g, out)) and sum(x[2] for x in got) == 14
    assert [few.schema[c].dataType.simpleString() for c in ("vls", "els", "n")] == ["array<int>", "array<int>", "bigint"]


def test_counts_without_distinct_ends(spark, toy):
    g = graph(spark, 5, [(i, 0) for i in range(5)], [(2, 3, 0), (2, 1, 0), (1, 0, 0), (2, 4, 0)])
    assert charsets.CharacteristicSets().estimate(g, TOY) == pytest.approx(0.45)
    assert "stats" not in g.__dict__  # ends are only estimated for who plans joins
    assert g.counts.items() <= g.stats.items() and g.counts["e"] == 4
