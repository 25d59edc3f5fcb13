"""Secret scanning through a trigram inverted index.

Each rule's regex yields a Boolean query over trigrams (every match must contain them),
one scan writes the postings of the trigrams that any query asks for, posting bitmaps
are intersected and united per block of documents, and only candidates are verified
with the regex.  A rule whose regex has no mandatory trigram scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as rc
from re import _parser as rp

from .common import text_of, written

#: Documents of a posting block: the bits of one bitmap, a power of two.
BLOCK = 32768
#: Bytes of candidate bitmaps that are broadcast at most.
BROADCAST = 1 << 26
#: Prefix sums over matches go by runs of this many, so a text of many matches stays far from quadratic.
RUN = 256


@dataclass(frozen=True)
class Rule:
    """``pattern`` is valid for Java, RE2 and Python; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: An equal pattern that finds the same spans with less work, where there is one.
    scan: str = ""


#: The base kinds of the contract, in its order, then further token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs are maximal, so a run of 24 or more is what the quantified class finds.
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----", 0, 20),
)
BASE = ("assign", "access", "hex")


def trigram_query(pattern: str, most: int = 64) -> list[list[str]]:
    """The regex's query as alternatives of trigrams that must all occur (lower case).

    An empty list says nothing is mandatory.  Exact strings are carried through
    concatenation, alternation and small classes; where they end, the strings gathered
    so far become alternatives.
    """

    def both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
        out = {x | y for x in a for y in b}
        return list(out) if len(out) <= most else (a if a != [frozenset()] else b)

    def grams(strings: set[str]) -> list[frozenset]:
        return list({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}) or [frozenset()]

    def seq(nodes) -> tuple[set[str] | None, list[frozenset]]:  # noqa: ANN001
        exact, query, whole = {""}, [frozenset()], True
        for op, arg in nodes:
            got, own = one(op, arg)
            if got is not None and len(exact) * len(got) <= most:
                exact = {x + y for x in exact for y in got}
                continue
            query, exact, whole = both(query, grams(exact)), got if got is not None else {""}, False
            query = both(query, own)
        if whole:
            return exact, [frozenset()]
        return None, both(query, grams(exact))

    def one(op, arg) -> tuple[set[str] | None, list[frozenset]]:  # noqa: ANN001
        nothing = (None, [frozenset()])
        if op is rc.LITERAL:
            return {chr(arg).lower()}, [frozenset()]
        if op is rc.IN:
            chars: set[str] = set()
            for o, a in arg:
                if o is rc.LITERAL:
                    chars.add(chr(a).lower())
                elif o is rc.RANGE and a[1] - a[0] < 8:
                    chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return nothing
            return (chars, [frozenset()]) if len(chars) <= 8 else nothing
        if op is rc.SUBPATTERN:
            return seq(arg[3])
        if op is rc.BRANCH:
            parts = [seq(p) for p in arg[1]]
            if all(e is not None for e, _ in parts):
                return set().union(*(e for e, _ in parts)), [frozenset()]
            return None, list({q for e, own in parts for q in (grams(e) if e is not None else own)})
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = arg
            exact, own = seq(inner)
            if (low, high) == (0, 1) and exact is not None:
                return exact | {""}, [frozenset()]
            if low == 0:
                return nothing
            return None, grams(exact) if exact is not None else own
        if op is rc.AT:
            return {""}, [frozenset()]
        return nothing

    exact, query = seq(rp.parse(pattern))
    found = grams(exact) if exact is not None else query
    if any(not q for q in found):
        return []
    least = [q for q in found if not any(o < q for o in found)]  # an alternative that another implies adds nothing
    return sorted(sorted(q) for q in least)


def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id") -> DataFrame:
    """The inverted index over these trigrams: (trigram, block, bits), one bitmap per block.

    A bitmap holds BLOCK consecutive ids, so no posting list grows without bound; null
    ids share a block of their own.  Bitmaps are built before the shuffle.
    """
    low = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("_id"), F.lower(text_of()).alias("_low"))
    wanted = F.array(*[F.lit(t) for t in trigrams])
    rows = low.select("_id", F.explode(F.filter(wanted, lambda t: F.contains(F.col("_low"), t))).alias("trigram"))
    block, bit = _place(F.col("_id"))
    return rows.groupBy("trigram", block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def _place(key: Column) -> tuple[Column, Column]:
    """Block and bit of a long, in integers: a double would round keys beyond 2**53 into the next block."""
    return F.shiftright(key, BLOCK.bit_length() - 1), F.pmod(key, F.lit(BLOCK)).cast("long")


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(block, a bitmap for each rule): ids whose postings satisfy the rule's query; null where a block has none."""
    clauses = [(kind, i, t, len(c)) for kind, alternatives in queries.items() for i, c in enumerate(alternatives) for t in c]
    terms = F.array(*[F.struct(*(F.lit(v).alias(c) for v, c in zip(x, ("kind", "clause", "trigram", "size"), strict=True))) for x in clauses])
    terms = index.sparkSession.range(1).select(F.inline(terms))
    hits = index.join(F.broadcast(terms), "trigram")  # the terms come from the rules, not from data
    clause = hits.groupBy("kind", "clause", "size", "block").agg(F.count(F.lit(1)).alias("_n"), F.bitmap_and_agg("bits").alias("bits"))
    rule = clause.where("_n = size").groupBy("kind", "block").agg(F.bitmap_or_agg("bits").alias("bits")).where(F.bitmap_count("bits") > 0)
    return rule.groupBy("block").agg(*[F.first(F.when(F.col("kind") == k, F.col("bits")), ignorenulls=True).alias(k) for k in queries])


def _flagged(docs: DataFrame, found: DataFrame, kinds: list[str], key: Column) -> DataFrame:
    """``docs`` with ``kinds``, the rules whose bitmap holds the row's key.

    The bitmaps, about a bit a rule for each id, go to the texts where they are under
    BROADCAST bytes; beyond that texts and bitmaps meet by block in a shuffle.
    """
    found = written(found, "candidates")
    small = found.count() * len(kinds) * (BLOCK // 8) <= BROADCAST
    block, bit = _place(key)
    df = docs.withColumn("block", block).join(F.broadcast(found) if small else found, "block", "left")

    def holds(kind: str) -> Column:
        octet = F.conv(F.hex(F.substr(F.col(kind), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftrightunsigned", octet, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

    return df.withColumn("kinds", F.filter(F.array(*[F.when(F.col(k).isNotNull() & holds(k), F.lit(k)) for k in kinds]), lambda x: x.isNotNull())).drop("block", *kinds)


def _matches(rule: Rule, kinds: Column, number: int, gated: bool) -> Column:
    """Struct of a rule's number and kind, code-point lengths of gaps and matches, and whether a match counts."""
    pattern = F.lit(rule.scan or rule.pattern)
    text = F.col("_t")
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = whole if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    found = F.struct(
        F.lit(number).alias("o"), F.lit(rule.kind).alias("kind"),
        F.transform(F.split(text, rule.scan or rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("len"),
        F.transform(part, lambda x: F.length(x) >= rule.least).alias("ok"),
    )
    asked = F.array_contains(kinds, rule.kind) if gated else text.rlike(rule.scan or rule.pattern)
    return F.when(asked, found)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and ``spans``: array of (s, o, e, kind) in order of start, then rule.

    Starts and ends are code points, end exclusive; matches of a rule are leftmost and
    do not overlap.  Null texts are empty.  Rows that repeat an id share its candidate
    flags (a union, so nothing is lost) and are each verified on their own text; null
    ids are candidates together.  The ids should be fairly dense: sparse ones are
    right but cost a bitmap each.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    gated = {k: q for k, q in queries.items() if q}
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_of().alias("_t"), F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("_key"))
    if gated:
        index = written(postings(docs, sorted({t for q in gated.values() for c in q for t in c}), key), "postings")
        base = _flagged(base, candidates(index, gated), list(gated), F.col("_key"))
    else:
        base = base.withColumn("kinds", F.array().cast("array<string>"))
    each = F.filter(F.array(*[_matches(r, F.col("kinds"), i, r.kind in gated) for i, r in enumerate(rules)]), lambda x: x.isNotNull())

    def steps(x: Column) -> Column:
        """Length of each gap with the match before it."""
        both = F.zip_with(F.slice(x["gap"], F.lit(1), F.size(x["len"])), F.concat(F.array(F.lit(0)), F.slice(x["len"], F.lit(1), F.greatest(F.size(x["len"]) - 1, F.lit(0)))), lambda g, m: g + m)
        return F.struct(x["o"].alias("o"), x["kind"].alias("kind"), x["len"].alias("len"), x["ok"].alias("ok"), both.alias("step"))

    def runs(x: Column) -> Column:
        n = F.size(x["step"])
        total = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(RUN)).cast("int")), lambda b: F.aggregate(F.slice(x["step"], b * F.lit(RUN) + 1, F.lit(RUN)), F.lit(0).cast("long"), lambda a, v: a + v))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(*[x[c].alias(c) for c in ("o", "kind", "len", "ok", "step")], total.alias("total"))

    def spans(x: Column) -> Column:
        def start(i: Column) -> Column:
            block = F.floor(i / F.lit(RUN)).cast("int")
            upto = F.aggregate(F.slice(x["total"], F.lit(1), block), F.lit(0).cast("long"), lambda a, v: a + v)
            return F.aggregate(F.slice(x["step"], block * F.lit(RUN) + 1, i % F.lit(RUN) + 1), upto, lambda a, v: a + v)

        def span(n: Column, i: Column) -> Column:
            return F.when(F.get(x["ok"], i), F.struct(start(i).alias("s"), x["o"].alias("o"), F.lit(0).cast("long").alias("e"), x["kind"].alias("kind"), n.alias("n")))

        return F.filter(F.transform(x["len"], span), lambda y: y.isNotNull())

    flat = F.flatten(F.transform(F.transform(F.transform(each, steps), runs), spans))
    done = F.transform(flat, lambda y: F.struct(y["s"].alias("s"), y["o"].alias("o"), (y["s"] + y["n"]).alias("e"), y["kind"].alias("kind")))
    return base.select(F.col("_row").alias("row"), F.sort_array(done).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one); columns of ``docs``.

    ``n_chars``, where there is one, counts the new text.
    """
    df = scan(docs, rules)
    # Spans come in order of start: cut from the furthest end reached so far.
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(a: Column, x: Column) -> Column:
        piece = F.substr(F.col("row.text"), (a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int"))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], F.concat(a["parts"], F.array(F.concat(piece, F.lit(mark))))).otherwise(a["parts"]).alias("parts"))

    def rest(a: Column) -> Column:
        return F.concat(F.array_join(a["parts"], ""), F.substr(F.col("row.text"), (a["at"] + 1).cast("int"), F.length("row.text")))

    new = F.when(F.size("spans") > 0, F.aggregate("spans", state, cut, rest)).otherwise(F.col("row.text"))
    df = df.withColumn("new", new)
    out = {"text": F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return df.select(*[out[c].alias(c) if c in out else F.col(f"row.`{c}`") for c in docs.columns])
