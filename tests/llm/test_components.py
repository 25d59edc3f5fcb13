"""Components of links and choice by bitmaps by each of their ways; what near_duplicates and near_dedup ask of Spark."""

import random

from graphtally.llm import common, components, near


def plain(links):
    root = {x: x for e in links for x in e}
    for u, v in links:
        a, b = sorted((root[u], root[v]))
        root = {k: a if x == b else x for k, x in root.items()}
    return root


def test_components(spark, monkeypatch):
    """In one task, and by contraction and stars where a task holds few links only: the same least nodes."""
    r = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, x) for x in range(450, 540) if x != 500] + [(r.randrange(1000, 1300) << 33, r.randrange(1000, 1300) << 33) for _ in range(150)]
    links = [e for e in links if e[0] != e[1]]
    r.shuffle(links)
    df = spark.createDataFrame(links + links[:20], "u long, v long").repartition(3)
    for most in (1 << 16, 8):
        monkeypatch.setattr(components, "AT_ONCE", most)
        got = components.components(df).collect()
        assert {x.node: x.root for x in got} == plain(links) and len(got) == len(plain(links)), most
    assert components.components(df.where("u < 0")).count() == 0


def test_near_asks_for_few_jobs(spark):
    """A chain of near copies beside pairs of them; each job costs its partitions' tasks whatever it holds (check_h: 211)."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs, at = [], [r.choice(words) for _ in range(120)]
    for i in range(40):
        at = list(at)
        at[r.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(at)))
    for i in range(40, 80, 2):
        at = [r.choice(words) for _ in range(120)]
        docs += [(i, " ".join(at)), (i + 1, " ".join([*at[:-1], "end"]))]
    context = spark.sparkContext
    context.setJobGroup("few-jobs", "near_duplicates")
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), near.Near(words=4, small=2))
    jobs = len(context.statusTracker().getJobIdsForGroup("few-jobs"))
    context.setJobGroup("", "")
    assert {x.component_id for x in got.collect()} == {0, *range(40, 80, 2)}
    assert jobs <= 80, jobs


def test_only(spark, monkeypatch):
    """By bitmaps and by a shuffle: the rows of these numbers, at block edges and both ends of the type too."""
    edges = [0, 1, 7, 8, 32767, 32768, 65535, (5 << 33) + 7, -1, -32768, -32769, 2**63 - 1, -(2**63)]
    rows = [(x, str(i)) for i, x in enumerate(edges + edges[:3])]
    df = spark.createDataFrame(rows, "number long, text string")
    for asked in (edges[::2], edges[1::2], []):
        ids = common.written(spark.createDataFrame([(x,) for x in asked], "number long"), "ids")
        for most in (64 << 20, 0):
            monkeypatch.setattr(common, "BITMAP_BYTES", most)
            assert sorted(common.only(df, ids, "number").collect()) == sorted(x for x in rows if x[0] in asked), (asked, most)


def test_near_dedup_shuffles_no_whole_rows(spark):
    """However large the table, the rows that stay are chosen where they lie."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = near.one_of_each(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h"), (4, "")], "doc_id long, text string"))
        assert sorted(x.doc_id for x in df.collect()) == [1, 3, 4]
        assert "SortMergeJoin" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
