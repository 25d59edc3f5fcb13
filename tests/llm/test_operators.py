"""Each operator against a plain version, with nulls, empty and odd texts, repeated rows and an empty table."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphtally.llm import chunks, langid, near, packing, pieces, quality, repeats, secrets, sharding, wavelet, webp
from graphtally.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kinds string, h string, key string"


def thue_morse(n, two):
    """A string of 2**n characters that collides with its complement under every polynomial hash modulo 2**64 from n = 10 on."""
    return "".join(two[i.bit_count() & 1] for i in range(1 << n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "k", "h", "k") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    base = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(r.randint(60, 90))) + "." for _ in range(6)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "Is it, two words! token = \"abcdef12\" é AKIA" + "Z9" * 12 + " " + "0a" * 20)]
    for i, b in enumerate(base):
        w = b.split()
        out += [(10 + 4 * i, b), (11 + 4 * i, b), (12 + 4 * i, " ".join([*w[:40], "changed", *w[41:]])), (13 + 4 * i, "other " + " ".join(w[:55]) + " end " * 30)]
    out += [(60, "x" * 900), (61, base[0] * 3), (62, "a | b | c\nHome | About | Contact\n" + base[2]), (63, base[1]), (63, base[1]), (None, base[3])]
    return out


def test_secrets(spark, rows):
    got = secrets.scan(table(spark, rows)).select("row.doc_id", "row.text", secrets.joined(F.col("spans"))).collect()
    assert len(got) == len(rows)
    for _, text, spans in got:
        want = sorted((m.start(), o, m.end(), r.kind) for o, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least)
        assert spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
    assert secrets.trigram_query(r"[0-9a-f]+") == [] and secrets.trigram_query("ab(cd|ef)g") == [["abc", "bcd", "cdg"], ["abe", "bef", "efg"]]
    assert secrets.scan(table(spark, [])).count() == 0
    red = {r.doc_id: r.text for r in secrets.redacted(table(spark, rows)).collect()}
    assert "AKIA" not in red[4] and red[1] == "" and red[0] is None


@pytest.mark.parametrize("broadcast", [1 << 26, 0])
def test_secrets_of_far_ids(spark, monkeypatch, broadcast):
    """Ids near block edges, beyond 2**53 on either side and at the ends of the type."""
    monkeypatch.setattr(secrets, "BROADCAST", broadcast)
    edges = [s * (1 << b) + d for b in (15, 53, 54, 60, 62) for s in (1, -1) for d in (-32769, -32768, -1, 0, 1, 32767, 32768)]
    ids = sorted({0, -1, -32768, (1 << 63) - 1, -(1 << 63), *edges})
    text = "a token = \"abcdef12\" and AKIA" + "Z9" * 12
    docs = table(spark, [(i, text) for i in ids] + [(None, text)])
    found = secrets.scan(docs).select("row.doc_id", secrets.joined(F.col("spans")).alias("spans")).collect()
    assert len(found) == len(ids) + 1 and {r.spans for r in found} == {"assign:2:19,access:25:53"}
    assert {r.text for r in secrets.redacted(docs).collect()} == {"a [SECRET]\" and [SECRET]"}


def test_quality(spark, rows):
    for r in quality.quality(table(spark, rows)).select("row.doc_id", "row.text", "q.*").collect():
        w = WORD.findall(r.text or "")
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    cleaned = {r.doc_id: r.text for r in quality.cleaned_documents(table(spark, rows)).collect()}
    assert "Home" not in cleaned[62] and cleaned[10] == dict(rows)[10] and 3 not in cleaned
    assert quality.cleaned_documents(table(spark, [])).count() == 0
    words = " ".join(f"word{i}" for i in range(80))
    kept = [(1, words), (2, "\n".join(" ".join(words.split()[i : i + 10]) for i in range(0, 80, 10))), (3, words + "\u0964"), (4, "")]
    got = {r.doc_id: (r.kept, r.n_lines_removed) for r in quality.quality(table(spark, kept)).select("row.doc_id", "q.*").collect()}
    assert got == {1: (True, 0), 2: (True, 1), 3: (True, 0), 4: (False, 0)}  # one line, wrapped prose but its last line, another script's mark


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    """The operators that SQL can say, on whole tables."""
    import duckdb

    from graphtally.llm import oracles, queries

    con, folder = duckdb.connect(), f"/root/testdata/{sf}"
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in oracles.ORACLES.items():
        df, r = queries.QUERIES[name](spark, folder), con.execute(sql)
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(df.columns), name
        assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(r.fetchall(), key=str), name


def test_sharding(spark, rows):
    many = rows + [(99, "same")] * 5000
    got = sharding.shard_rows(table(spark, many), 24).toPandas()
    assert len(got) == len(many) and sorted(got.row_number) == list(range(len(many)))
    assert sorted(zip(got.slot * 24 + got.shard, strict=True)) == [(i,) for i in range(len(many))]
    assert sharding.shard_rows(table(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids(rows, name):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_file(name))
    r = random.Random(3)
    texts = [x for _, x in rows] + ["".join(r.choice("ab ,.'\n é́漢　\xa0 s1!\x1c<|endoftext|> t") for _ in range(r.randint(0, 40))) for _ in range(800)]
    texts += ["ab<|endoftext|> cd", "<|startoftext|>a", "a <|endoftext|>.", "x.<|endoftext|><|endoftext|>é 1", thue_morse(10, "ab"), thue_morse(10, "ba"), thue_morse(14, "ab"), thue_morse(14, "ba")]
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [i.tolist() for _, i in chunks.bpe(tokenizer_file(name))(pa.array(texts))] == want


def test_chunk_table_bounds(rows, monkeypatch):
    """What is kept of many different long chunks is bounded, keys included; small bounds and slices give the same ids."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_file("byte_bpe_50k.json"))
    r = random.Random(5)
    texts = [" " + "".join(r.choice("abcdefgh") for _ in range(24)) for _ in range(4000)]
    monkeypatch.setattr(chunks, "MOST_LONG", 1 << 16)
    monkeypatch.setattr(chunks, "_kept", {})
    encode = chunks.bpe(tokenizer_file("byte_bpe_50k.json"))
    most = 0
    for i in range(0, len(texts), 50):
        list(encode(pa.array(texts[i : i + 50])))
        most = max(most, len(encode.long))
    assert 50 <= most <= (1 << 16) // 256 + 50
    for name, size in (("MOST", 300), ("MOST_IDS", 500), ("NEW_AT_ONCE", 7), ("AT_ONCE", 2000)):
        monkeypatch.setattr(chunks, name, size)
    encode.clear()
    texts = [x for _, x in rows] + texts[:200] + [thue_morse(10, "ab")]
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [i.tolist() for _, i in encode(pa.array(texts))] == want


def test_packing(spark, rows):
    got = packing.pack(table(spark, rows), tokenizer_file("word_bpe_49k.json"), 1, 64).toPandas()
    assert got.length.sum() == got[got.start == 0].doc_tokens.sum() and (got.start == 0).sum() == len(rows)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length).tolist()[:-1]] and g.length.sum() <= 64
    assert packing.pack(table(spark, []), tokenizer_file("word_bpe_49k.json")).count() == 0
    pattern = packing.shortest_pack_first({10: 7, 3: 9, 1: 2}, 13)
    assert sum(n * p.count(10) for n, p in pattern) == 7 and sum(n * p.count(3) for n, p in pattern) == 9 and all(sum(p) <= 13 for _, p in pattern)


def test_wavelet(spark, rows):
    a = np.random.default_rng(1).integers(0, 300, 3000).astype(np.uint32)
    w = wavelet.WaveletMatrix(wavelet.build(a, [1, None], [1000, 2000]))
    assert (w.decode() == a).all() and w.doc_ids == [1, None]
    for i in range(0, 3000, 371):
        k = int((a[:i] == a[i]).sum())
        assert w.access(i) == a[i] and w.rank(int(a[i]), i) == k and w.select(int(a[i]), k) == i
    assert list(w.occurrences(7)) == np.flatnonzero(a == 7).tolist() and w.count(1 << 20) == 0
    for n, kinds in ((1, 1), (7, 3), (1 << 16, 5), (1 << 16 | 1, 2), (200000, 50000), (3 << 16, 70000)):  # up to several blocks of a plane
        a = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint32)
        w = wavelet.WaveletMatrix(wavelet.build(a, [1], [n]))
        for symbol in {int(a[0]), int(a[n // 2]), int(a[-1])}:
            want = np.flatnonzero(a == symbol)
            some = sorted({0, len(want) // 3, len(want) // 2, len(want) - 1})
            assert [w.select(symbol, k) for k in some] == want[some].tolist() and w.count(symbol) == len(want)
            with pytest.raises(IndexError):
                w.select(symbol, len(want))
    unique = list({i: t for i, t in rows}.items())
    got = wavelet.write_and_read(table(spark, unique), tokenizer_file("byte_bpe_50k.json")).collect()
    got = sorted(got, key=lambda r: r.start)
    keys = [r.doc_id for r in got]
    assert keys == sorted(dict(unique), key=lambda k: (k is not None, k or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert next(r for r in got if r.doc_id == 1).ids_crc32 == zlib.crc32(b"\0\0\0\0")
    assert wavelet.write_and_read(table(spark, []), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_pieces(spark, rows):
    import public_tokenizers
    import sentencepiece

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto = f.read()
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
    r = random.Random(4)
    more = [(100 + i, "".join(r.choice("ab thesing ,.▁\n é漢😀hhh") for _ in range(r.randint(0, 60)))) for i in range(1500)]
    more += [(5000 + i, x) for i, x in enumerate([thue_morse(10, "ab"), thue_morse(10, "ba"), thue_morse(12, "xy"), thue_morse(12, "yx"), " " * 3000, "a  b   c" + " " * 77, "▁▁ ▁", "word " * 4000])]
    for x in pieces.encoded(table(spark, rows + more), proto).join(table(spark, rows + more).select("doc_id", "text").distinct(), "doc_id").collect():
        ids = lib.encode(x.text or "")
        assert np.frombuffer(x.ids, "<u4").tolist() == ids and x.decoded == lib.decode(ids)


def test_webp(spark, rows):
    r = random.Random(1)
    payloads = [b"\0" * 64, bytes(range(256)), r.randbytes(640), b"ab" * 64, b"a" * 6400, bytes((x + y) & 255 for y in range(50) for x in range(64)), r.randbytes(webp.PIECE), r.randbytes(webp.PIECE - 64), r.randbytes(webp.PIECE + 64), b"ab c" * (webp.PIECE // 2 + 16)]
    payloads += [bytes(r.choices(range(k), k=64 * r.randint(1, 20))) for k in (1, 2, 3, 4, 5, 15, 16, 17) for _ in range(4)]
    for payload in payloads:
        assert webp.load(webp.store(payload), len(payload)).tobytes() == payload
    for r in webp.media(table(spark, rows)).join(table(spark, rows).select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r.text or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert webp.media(table(spark, [])).count() == 0


def test_webp_in_pieces(spark, monkeypatch):
    """Long texts are files in a row, each complete; pieces change neither payload nor features; a cut or swollen row is refused."""
    r = random.Random(3)
    payload = bytes(r.choices(b"some words and \n", k=64 * 50))
    whole, feature = webp.store(payload), webp.features(np.frombuffer(payload, np.uint8))
    back = np.frombuffer(payload, np.uint8)
    assert f"step={np.abs(np.diff(back.astype(int))).mean():.4f}" in feature and f"mean={back.mean():.4f};std={back.std():.4f}" in feature
    monkeypatch.setattr(webp, "PIECE", 64 * 7)
    several = webp.store(payload)
    assert several.count(b"WEBPVP8L") == 8 and whole.count(b"WEBPVP8L") == 1
    assert webp.load(several, len(payload)).tobytes() == webp.load(whole, len(payload)).tobytes() == payload
    assert webp.features(webp.load(several, len(payload))) == feature
    first = several[: 8 + int.from_bytes(several[4:8], "little")]
    assert webp.decode(first).shape == (7, 64, 4) and webp.load(first, 64 * 7).tobytes() == payload[: 64 * 7]
    for stored, size in ((first, len(payload)), (several + first, len(payload)), (several[:-40], len(payload)), (several, 64 * 8)):
        with pytest.raises(ValueError):
            webp.load(stored, size)
    monkeypatch.undo()
    text = "long \u00e9 text, " * 60000
    (row,) = webp.media(table(spark, [(1, text)])).collect()
    raw = text.encode()
    padded = raw + b"\0" * (-len(raw) % 64)
    assert (row.n_bytes, row.payload_sha256) == (len(raw), hashlib.sha256(padded).hexdigest()) and bytes(row.media).count(b"WEBPVP8L") == -(-len(padded) // webp.PIECE)


def test_webp_features_met_by_the_table(spark, monkeypatch):
    """What the stored forms of a table's texts hold: references and palettes are met, and a predictor where it pays."""
    met = collections.Counter()
    for name in ("_undo_palette", "_undo_predictor", "_add_green", "_copy"):
        f = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, f=f, name=name: (met.update({name: len(a[1]) if name == "_copy" else 1}), f(*a))[1])
    texts = [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    digits = "".join(random.Random(0).choices("01", k=2000)).encode()
    for t in [*texts, b"", b"aab", digits]:
        payload = t + b"\0" * (max(64, -(-len(t) // 64) * 64) - len(t))
        assert webp.load(webp.store(payload), len(payload)).tobytes() == payload
    assert met["_copy"] > 300 and met["_add_green"] > 100 and met["_undo_palette"] > 0, met
    ramp = bytes((3 * x + 5 * y + (x * y) % 3) & 255 for y in range(64) for x in range(64))
    assert webp.load(webp.store(ramp), len(ramp)).tobytes() == ramp and met["_undo_predictor"] > 0


def test_cross_colour():
    r = random.Random(5)
    px = np.array([r.getrandbits(32) for _ in range(64)], np.uint32)
    parts = np.array([r.getrandbits(32) for _ in range(4)], np.uint32)  # blocks of 4 x 4 in 8 x 8 pixels
    got = webp._split(webp._undo_cross(px, 8, 8, 2, parts)).tolist()

    def signed(v):
        return v - 256 if v > 127 else v

    for i, (a, red, green, blue) in enumerate(webp._split(px).tolist()):
        _, red_to_blue, green_to_blue, green_to_red = webp._split(parts)[(i // 8 >> 2) * 2 + (i % 8 >> 2)].tolist()
        red = (red + (signed(green_to_red) * signed(green) >> 5)) & 255
        blue = (blue + (signed(green_to_blue) * signed(green) >> 5) + (signed(red_to_blue) * signed(red) >> 5)) & 255
        assert got[i] == [a, red, green, blue]


def test_webp_features_of_the_format():
    """A hand-made stream: palette of two colours packed eight to a byte, a back reference and a colour cache."""
    w = webp.BitWriter()
    w.put(0x2F, 8), w.put(15, 14), w.put(1, 14), w.put(0, 4)
    w.put(1, 1), w.put(3, 2), w.put(1, 8)  # palette of two
    w.put(0, 1)  # no cache
    for table_ in ({5: 1, 9: 1}, {1: 1}, {2: 1}, {255: 1, 0: 1}, {0: 1}):
        w.prefix([table_.get(i, 0) for i in range(280 if 5 in table_ else 256)])
    w.put(0, 1), w.put(1, 1)  # green 5, alpha 255 (codes: 0 for the lower symbol)
    w.put(1, 1), w.put(0, 1)  # green 9 (difference), alpha 0
    w.put(0, 1)  # no further transform
    w.put(1, 1), w.put(1, 4)  # cache of two
    w.put(0, 1)  # one group
    green = [0] * 282
    green[0b10100101] = 2
    green[0b11110000] = 2
    green[256] = 2  # copies of length 1
    green[280 + ((0x1E35A7BD * 0xFF00F000 & 0xFFFFFFFF) >> 31)] = 2
    code = webp.written_codes(green)
    w.prefix(green)
    for only in (0, 0, 255, 1):
        w.prefix([1 if i == only else 0 for i in range(256)])
    for s in (0b10100101, 0b11110000, 256, 280 + ((0x1E35A7BD * 0xFF00F000 & 0xFFFFFFFF) >> 31)):
        w.put(code[s], 2)
    got = webp.decode(webp.riff(w.bytes()))
    low, high = (1, 5, 2, 255), (2, 14, 4, 255)
    bits = [0b10100101, 0b11110000, 0b11110000, 0b11110000]
    got = got.reshape(-1, 4)
    first = [tuple(x) for x in got[:8].tolist()]
    assert first == [high if 0b10100101 >> i & 1 else low for i in range(8)] and len(got) == 32 and len(bits) == 4


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    r = random.Random(mode)
    px = np.array([r.getrandbits(32) for _ in range(12)], np.uint32)
    got = webp._split(webp._undo_predictor(px, 4, 3, 2, np.array([mode << 8], np.uint32)))
    assert got[0].tolist() == [(a + b) & 255 for a, b in zip(webp._split(px)[0].tolist(), [255, 0, 0, 0], strict=True)]
    c, d = got.tolist(), webp._split(px).tolist()

    def foretold(i):
        left, top, corner, right = c[i - 1], c[i - 4], c[i - 5], c[i - 3]
        half = [(a + b) // 2 for a, b in zip(left, top, strict=True)]
        if mode == 11:
            near = sum(abs(t - k) for t, k in zip(top, corner, strict=True)), sum(abs(x - k) for x, k in zip(left, corner, strict=True))
            return left if near[0] < near[1] else top
        one = {
            0: lambda k: (255, 0, 0, 0)[k], 1: lambda k: left[k], 2: lambda k: top[k], 3: lambda k: right[k], 4: lambda k: corner[k], 5: lambda k: ((left[k] + right[k]) // 2 + top[k]) // 2,
            6: lambda k: (left[k] + corner[k]) // 2, 7: lambda k: half[k], 8: lambda k: (corner[k] + top[k]) // 2, 9: lambda k: (top[k] + right[k]) // 2,
            10: lambda k: ((left[k] + corner[k]) // 2 + (top[k] + right[k]) // 2) // 2, 12: lambda k: min(255, max(0, left[k] + top[k] - corner[k])),
            13: lambda k: min(255, max(0, half[k] + int((half[k] - corner[k]) / 2))),
        }[mode]
        return [one(k) for k in range(4)]

    for i in (5, 6, 7, 9, 10, 11):
        assert c[i] == [(x + y) & 255 for x, y in zip(d[i], foretold(i), strict=True)]
    assert c[2] == [(x + y) & 255 for x, y in zip(d[2], c[1], strict=True)] and c[8] == [(x + y) & 255 for x, y in zip(d[8], c[4], strict=True)]


def test_langid(spark):
    r = random.Random(2)
    syl = {"aa": ["ba", "bo", "bi"], "zz": ["xu", "xe", "qo"]}
    docs = [(i, " ".join("".join(r.choice(syl[k]) for _ in range(3)) for _ in range(20)), k) for i in range(120) for k in [("aa", "zz")[i % 2]]] + [(500, None, "aa"), (501, "12 !", None)]
    got = langid.identified(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(docs)
    want = {d[0]: d[2] for d in docs}
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1
        assert x.lang_pred == ("und" if x.doc_id >= 500 else want[x.doc_id])
    none = langid.identified(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).head()
    assert (none.lang_pred, none.score) == ("und", 0.0)


def test_langid_learns_a_language_of_one_repeated_row(spark):
    once = [(i, "baba bobo bibi", "aa") for i in range(1000)]
    training = [i for i in range(5000, 5020) if zlib.crc32(str(i).encode()) % 3 != 1]
    for i in training[:3]:
        df = spark.createDataFrame(once + [(i, "xuxe qoqo xexe", "zz")] * 20000, "doc_id long, text string, lang string").repartition(4)
        assert {r.lang_pred for r in langid.identified(df).where(f"doc_id = {i}").distinct().collect()} == {"zz"}


def test_repeats(spark, rows):
    def plain(size, rows=rows):
        data = [(t or "").encode() for _, t in rows]
        seen = collections.Counter(b[p : p + size] for b in data for p in range(len(b) - size + 1))
        out = []
        for b in data:
            gone = {q for p in range(len(b) - size + 1) if seen[b[p : p + size]] > 1 for q in range(p, p + size)}
            out.append((len(b), len(gone), sum(q - 1 not in gone for q in gone), hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()))
        return sorted(out)

    for size, gram, gather in ((40, 15, 4096), (100, 37, 2)):
        got = repeats.remove_repeats(table(spark, rows), repeats.Repeats(size=size, gram=gram, gather=gather)).collect()
        assert sorted(tuple(r)[1:5] for r in got) == plain(size)
        assert all(r.n_removed or r.text == (dict(rows)[r.doc_id] or "") for r in got if r.doc_id != 63)
    # At the contract's size: long shared passages at every offset, near copies, periods, a long text, strings that collide under polynomial hashes.
    r = random.Random(12)
    word = ["".join(r.choice("abcdefghij é") for _ in range(r.randint(2, 9))) for _ in range(900)]
    shared = [" ".join(r.choices(word, k=r.randint(60, 160))) for _ in range(8)]
    more = [(i, " ".join(r.choices(word, k=r.randint(5, 90))) + r.choice(shared)[r.randrange(40) :] + " ".join(r.choices(word, k=r.randint(5, 90)))) for i in range(60)]
    more += [(100 + i, shared[0][: 380 + 5 * i]) for i in range(12)] + [(120, "ab" * 700), (121, "x" + "ab" * 250), (122, "long " + " ".join(r.choices(word, k=12000))), (123, shared[1]), (123, shared[1]), (124, None), (125, "")]
    more += [(126, thue_morse(11, "ab")), (127, thue_morse(11, "ba")), (128, thue_morse(9, "xy")), (129, thue_morse(9, "yx"))]
    for gather in (4096, 3):
        got = repeats.remove_repeats(table(spark, more), repeats.Repeats(gather=gather))
        assert sorted(tuple(r)[1:5] for r in got.collect()) == plain(400, more)
    assert repeats.remove_repeats(table(spark, [])).count() == 0
    words = [WORD.findall(t or "") for _, t in more]
    seen = collections.Counter(tuple(w[i : i + 50]) for w in words for i in range(len(w) - 49))
    stays = []
    for w in words:
        gone = {q for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] > 1 for q in range(i, i + 50)}
        stays.append([x for q, x in enumerate(w) if q not in gone])
    for gather in (4096, 2):
        left = repeats.without_repeats(table(spark, more), repeats.Repeats(size=50, unit="words", gram=19, gather=gather))
        # A cut joins what stays on its sides, so letters are compared, not words.
        assert sorted("".join(WORD.findall(r.text or "")) for r in left.collect()) == sorted("".join(x) for x, w in zip(stays, words, strict=True) if x or not w)
    left = repeats.without_repeats(table(spark, rows), repeats.Repeats(size=50, unit="words", gram=19))
    assert {r.doc_id for r in left.where("doc_id in (10, 11)").collect()} == set()


def test_repeats_counts_passages_of_few_bytes(spark):
    """Fifty-five words that repeat across texts in fewer bytes than are removed, or with other blanks."""
    r = random.Random(31)
    word = lambda n: ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    short, long = word(55), word(90)
    assert len(" ".join(short)) < 400 < len(" ".join(long))
    docs = [(i, " ".join(word(30) + short + word(30 + i))) for i in range(3)] + [(9, " ".join(word(130)))]
    docs += [(20, " ".join(word(20) + long)), (21, "\n".join(long)), (22, " ".join(short[:49])), (23, None), (24, " ".join(short[:50]))]
    p = repeats.Repeats(size=50, unit="words", gram=19)
    got = {x.doc_id: (x.n_removed, x.n_passages, x.n_passage_bytes) for x in repeats.remove_repeats(table(spark, docs), repeats.Repeats(), p).collect()}
    want = {i: (0, 1, 55 * 6 - 1) for i in range(3)} | {9: (0, 0, 0), 20: (0, 1, 90 * 6 - 1), 21: (0, 1, 90 * 6 - 1), 22: (0, 0, 0), 23: (0, 0, 0), 24: (0, 1, 50 * 6 - 1)}
    assert got == want


def test_near(spark, rows):
    def plain(k):
        sets = []
        for _, t in rows:
            w = (t or "").encode().lower().split()
            sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
        root = list(range(len(rows)))
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    x, y = root[i], root[j]
                    root = [min(x, y) if q in (x, y) else q for q in root]
        least = collections.defaultdict(list)
        for q, (i, _) in zip(root, rows, strict=True):
            least[q].append(i)
        return sorted(((len(s), min((x for x in least[q] if x is not None), default=None)) for s, q in zip(sets, root, strict=True)), key=str)

    got = near.near_duplicates(table(spark, rows), near.Near(words=4)).collect()
    assert sorted(((r.n_shingles, r.component_id) for r in got), key=str) == plain(4)
    assert near.near_duplicates(table(spark, [])).count() == 0


def test_near_compares_content(spark):
    """Words that collide under every polynomial hash modulo 2**64 are different words."""
    docs = [(i, " ".join([thue_morse(11, two)] * 5 + [thue_morse(10, two)])) for i, two in enumerate(("ab", "ba", "ab"))]
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {0: 0, 1: 1, 2: 0}


def test_near_block_comparison(spark):
    """With no pivot rounds and tiny blocks the block path alone must find the links."""
    r = random.Random(6)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    docs = []
    for i in range(30):
        w = list(base)
        for _ in range(5):
            w[r.randrange(200)] = f"w{i}{r.random()}"
        docs.append((i, " ".join(w)))
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), near.Near(words=2, rounds=0, small=2, block=4)).collect()
    assert {x.component_id for x in got} == {0}


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """A doubled row, several texts under one id or under null, copies across them, blank texts."""
    import corpus_pipeline

    r = random.Random(11)
    a, b, c, d, e, f, g = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(7))
    near_c = " ".join([*c.split()[:-1], "changed"])
    docs = [
        (7, a), (7, a),  # a row present twice
        (None, b), (None, b), (None, d), (None, near_c), (3, c),  # null ids: b and d have nothing else, near_c goes with c
        (5, e), (5, f), (2, f), (5, f),  # id 5: e stays, f goes with id 2
        (9, g), (None, g), (8, " ".join([*g.split()[:-1], "changed"])),
        (6, " "), (6, " "), (None, None),
    ]
    got = corpus_pipeline.near_dedup(spark, table(spark, docs).repartition(5), "")
    assert got.columns == table(spark, []).columns
    want = [(7, a), (None, b), (None, d), (3, c), (5, e), (2, f), (8, docs[13][1]), (6, " "), (6, " "), (None, None)]
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted(want, key=str)
    left = corpus_pipeline.repeat_removal(spark, table(spark, [(7, a), (7, a), (1, b)]).transform(lambda x: corpus_pipeline.near_dedup(spark, x, "")), "")
    assert sorted((x.doc_id, x.text) for x in left.collect()) == [(1, b), (7, a)]
    assert corpus_pipeline.near_dedup(spark, table(spark, []), "").count() == 0


def test_columns_of_any_name(spark, rows):
    """Extra columns whose names the operators might use themselves come through untouched."""
    import corpus_pipeline

    names = ["_kept", "_q", "_spans", "_left", "_new", "_h", "_part", "_row", "_t", "_key", "row", "q", "spans", "left", "h", "c", "n", "part", "number", "new", "kinds", "sig", "a.b"]
    docs = table(spark, rows).select("doc_id", "text", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(list(r)[2:] == [f"x{i}" for i in range(len(names))] for r in got), name
    for one in (near.near_duplicates, repeats.remove_repeats, sharding.shard_rows, webp.media):
        assert one(docs).count() == len(rows)
    assert langid.identified(docs.withColumn("lang", F.lit("aa"))).count() == len(rows)


def plain_pipeline(docs):
    """The pipeline's stages on lists of (doc_id, text), without an operator of the library; (doc_id, text) that are packed."""
    r, out = quality.LineRules(), []
    for i, text in docs:
        text = text or ""
        words, lines, kept = WORD.findall(text), text.split("\n"), []
        grams = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
        for k, line in enumerate(lines):
            n = len(WORD.findall(line))
            symbols = len(re.findall(r"[#*$%&|<>]", line)) + len(re.findall(r"[!?]{2,}", line))
            goes_on = k + 1 < len(lines) and re.match(r"[ \t]*[^\W\d_]", lines[k + 1]) and lines[k + 1].lstrip(" \t")[0].islower()
            unended = r.min_words_for_end <= n <= r.max_words_for_end and line.strip(" \t\n\x0b\f\r")[-1:] not in r.ends and not goes_on
            bars = sum(x in ("|", "\u00bb", "\u2022", ">", "/") for x in re.split(r"[ \t]", line))
            if not n or not (unended or symbols > n * r.max_symbol_share or (bars >= r.min_separators and bars >= n * r.min_separator_share) or any(p in line.lower() for p in r.phrases)):
                kept.append(line)
        left = "\n".join(kept)
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and 100 * (len(words) - len(WORD.findall(left))) <= r.max_lost_percent * len(words):
            out.append((i, left))
    sets = []
    for _, t in out:
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(out)))
    for i in range(len(out)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if q in (root[i], root[j]) else q for q in root]
    groups = collections.defaultdict(list)
    for q, d in zip(root, out, strict=True):
        groups[q].append(d)
    out = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]
    spans = [list(WORD.finditer(t)) for _, t in out]
    seen = collections.Counter(tuple(m[0] for m in w[k : k + 50]) for w in spans for k in range(len(w) - 49))
    cut = []
    for (i, t), w in zip(out, spans, strict=True):
        gone = [False] * len(t)
        for k in range(len(w) - 49):
            if seen[tuple(m[0] for m in w[k : k + 50])] > 1:
                gone[w[k].start() : w[k + 49].end()] = [True] * (w[k + 49].end() - w[k].start())
        left = "".join(c for c, g in zip(t, gone, strict=True) if not g)
        if WORD.search(left):
            cut.append((i, left))
    clean = []
    for i, t in cut:
        found = sorted((m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.pattern, t) if len(m.group(rule.group)) >= rule.least)
        parts, at = [], 0
        for s, e in found:
            if s >= at:
                parts += [t[at:s], "[SECRET]"]
            at = max(at, e)
        clean.append((i, "".join(parts) + t[at:]))
    return clean


def test_pipeline_against_plain(spark, tmp_path):
    """run() on a doubled row, null ids, near copies, shared passages, secrets, junk and long texts."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    r = random.Random(31)
    word = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(3000)]

    def prose(n):
        return ". ".join(" ".join(r.choices(word, k=12)).capitalize() for _ in range(n // 12)) + "."

    texts = [prose(120) for _ in range(12)]
    passage = prose(72)
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, prose(90)), (40, texts[2].replace(word[5], "x") + " Extra."), (41, texts[3].lower())]
    docs += [(50 + i, prose(60) + "\n" + passage + "\n" + prose(60)) for i in range(3)]
    docs += [(60, prose(60) + ' password = "abcdefgh12" AKIA' + "Q7" * 12 + " " + "0f" * 16 + ". " + prose(24)), (61, prose(60) + "\nHome | About | Contact\nclick here to go on\n" + prose(24))]
    docs += [(62, None), (63, ""), (64, "short"), (65, "same words again " * 60), (66, prose(6000)), (1 << 60, texts[4][:-1] + "!")]
    spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_str(tokenizer_file("word_bpe_49k.json"))
    want = []
    for i, text in plain_pipeline(docs):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            want.append((i, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got), key=str) == sorted(want, key=str)
    for k in {x.sequence_id for x in got}:
        own = sorted((x.offset, x.length) for x in got if x.sequence_id == k)
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 2048


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, docs, "")
        assert df.columns == columns, name
        df.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").toPandas()
    assert set(out.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()} and out.groupby("sequence_id").length.sum().max() <= 2048
