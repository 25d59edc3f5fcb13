"""Line-first cleaning: rules judge lines, failing lines go, then documents are judged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, text_of, words_of

SYMBOLS = "#*$%&|<>"


#: Marks that end a line (closing quotes and brackets may stand last), and phrases in lower case.
ENDS = ".!?\u2026:;,\"')]}\u00bb\u201d\u2019\u3002\uff01\uff1f\u0964\u0965\u061f\u06d4\u0589\u1362"
#: What a line that runs on from the one before starts with.
GOES_ON = r"^[\x20\x09]*\p{Ll}"
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "accept cookies",
    "enable javascript", "licensed under", "subscribe to our", "sign up for", "click here", "skip to content", "skip to main content", "lorem ipsum",
)


@dataclass(frozen=True)
class LineRules:
    """A line without words always stays. Shares are per word of the line."""

    #: Punctuation: a line of so many words ends in one of ``ends``, or fails; not one that the
    #: next line goes on with a small letter (wrapped prose), nor a longer one (a paragraph).
    min_words_for_end: int = 5
    max_words_for_end: int = 40
    ends: str = ENDS
    #: Punctuation: symbols and doubled marks (!!, ??) in more than this share of words.
    max_symbol_share: float = 0.30
    #: Navigation: separators between short items, at least so many and this share of words.
    min_separators: int = 2
    min_separator_share: float = 0.20
    #: Boilerplate: a line that holds one of these.
    phrases: tuple[str, ...] = PHRASES
    #: A document that loses more than this percentage of its words is rejected.
    max_lost_percent: int = 50


def _holds_phrase(low: Column, rules: LineRules) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in rules.phrases]), lambda p: F.contains(low, p))


def _line_kept(x: Column, rules: LineRules) -> Column:
    """``x``: line, after (the next line), n (words), symbols, phrase (whether it holds one)."""
    symbols = x["symbols"] + F.regexp_count(x["line"], F.lit(r"[!?]{2,}"))
    judged = (x["n"] >= rules.min_words_for_end) & (x["n"] <= rules.max_words_for_end)
    unended = judged & ~F.contains(F.lit(rules.ends), F.right(F.btrim(x["line"], F.lit(BLANKS)), F.lit(1))) & ~F.coalesce(x["after"].rlike(GOES_ON), F.lit(False))
    separators = F.regexp_count(x["line"], F.lit(r"(^|[\x20\x09])[|\x{00BB}\x{2022}>/](?=[\x20\x09]|$)"))
    navigation = x["line"].rlike(r"[|\x{00BB}\x{2022}>/]") & (separators >= rules.min_separators) & (separators >= x["n"] * F.lit(rules.min_separator_share))
    return (x["n"] == 0) | ~(unended | (symbols > x["n"] * F.lit(rules.max_symbol_share)) | navigation | x["phrase"])


def quality(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:  # noqa: B008
    """Two structs: ``row``, all columns of ``docs``, and ``q``, the measures, the verdict and the cleaned text.

    ``q``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_lines_removed, words_left (long), base_failed, kept (boolean), cleaned (string).
    Null and blank texts have no words and fail.  Repeated words are counted through
    64-bit packed hashes of the three-word windows; only windows that share a hash are
    compared as text, so counts are exact and the work is n log n in a text's words.
    Everything happens within the row: no shuffle, whatever a source or id holds.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_of().alias("_t"))
    df = df.withColumn("_w", words_of(F.col("_t"))).withColumn("_lines", F.split("_t", "\n", -1)).withColumn("_low", F.lower("_t"))
    df = df.withColumn("_m", F.size("_w") - 2)
    # Hash above, position below. Beyond 2**24 words positions don't fit and all windows are compared.
    packed = F.transform(
        F.sequence(F.lit(0), F.col("_m") - 1),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).bitwiseAND(F.lit(~0xFFFFFF)).bitwiseOR(i.cast("long")),
    )
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_s", F.when((F.col("_m") > 0) & (F.col("_m") <= 1 << 24), F.sort_array(packed)).otherwise(none))

    def same(k: Column, x: Column) -> Column:
        return F.coalesce(F.shiftrightunsigned(F.get("_s", k).bitwiseXOR(x), 24) == 0, F.lit(False))

    # Most texts repeat no window: one look at each neighbour settles those.
    df = df.withColumn("_d", F.size(F.filter("_s", lambda x, k: same(k + 1, x))))
    alike = F.transform(F.filter("_s", lambda x, k: same(k + 1, x) | ((k > 0) & same(k - 1, x))), lambda x: x.bitwiseAND(F.lit(0xFFFFFF)).cast("int"))
    alike = F.when(F.col("_d") > 0, alike).otherwise(F.array().cast("array<int>"))
    every = F.when(F.col("_m") > 1 << 24, F.sequence(F.lit(0), F.col("_m") - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_c", F.when(F.col("_m") > 1 << 24, every).otherwise(alike)).drop("_s")
    windows = F.transform("_c", lambda i: F.struct(F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("w"), i.alias("i")))
    df = df.withColumn("_v", F.sort_array(windows))

    def equal(k: Column, x: Column) -> Column:
        return F.coalesce(F.get("_v", k)["w"] == x["w"], F.lit(False))

    twice = F.filter("_v", lambda x, k: equal(k + 1, x) | ((k > 0) & equal(k - 1, x)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda s, p: F.struct(p.alias("at"), (s["n"] + F.least(F.lit(3), p - s["at"])).alias("n")),
        lambda s: s["n"],
    )
    wordy = F.filter("_lines", lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumn("_wordy", wordy)

    def facts(phrase: bool) -> Column:
        return F.transform(
            "_lines",
            lambda x, i: F.struct(
                x.alias("line"), F.get("_lines", i + 1).alias("after"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"), F.regexp_count(x, F.lit(r"[#*$%&|<>]")).alias("symbols"),
                (_holds_phrase(F.lower(x), rules) if phrase else F.lit(False)).alias("phrase"),
            ),
        )

    # Lines are searched for phrases only where the text holds one.
    judged = F.when(_holds_phrase(F.col("_low"), rules), facts(True)).otherwise(facts(False))
    df = df.withColumn("_kept_lines", F.transform(F.filter(judged, lambda x: _line_kept(x, rules)), lambda x: x["line"]))
    df = df.withColumn("_removed", F.size("_lines") - F.size("_kept_lines"))
    df = df.withColumn("_cleaned", F.when(F.col("_removed") == 0, F.col("_t")).otherwise(F.array_join("_kept_lines", "\n")))
    n = F.size("_w").cast("long")
    df = df.select(
        "_row", "_cleaned", n.alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_wordy") - F.size(F.array_distinct("_wordy"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_lines_removed"),
        F.when(F.col("_removed") == 0, n).otherwise(F.size(words_of(F.col("_cleaned"))).cast("long")).alias("words_left"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("words_left")) <= rules.max_lost_percent * F.col("n_words")))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_removed", "words_left", "base_failed", "kept"]
    return df.select(F.col("_row").alias("row"), F.struct(*measures, F.col("_cleaned").alias("cleaned")).alias("q"))


def cleaned_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:  # noqa: B008
    """The documents that pass, each without its failing lines; the columns of ``docs``.

    ``n_chars``, where there is one, counts the cleaned text.
    """
    # A filter on the verdict alone would be pushed down with all that computes it, and evaluated over and over.
    q = quality(docs, rules).withColumn("part", F.spark_partition_id()).where("q.kept and part >= 0")
    new = {"text": F.col("q.cleaned")} | ({"n_chars": F.length("q.cleaned").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return q.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
