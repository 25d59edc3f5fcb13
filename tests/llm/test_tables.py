"""The registered queries that have no SQL, over whole given tables, against plain versions of their contracts."""

import collections
import hashlib
import re
import struct
import zlib

import pytest

from graphtally.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"


def texts(spark, folder=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def library_ids(docs, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_file(name))
    return {i: [*e.ids, end] for i, e in zip(docs, t.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}


def test_op2(spark):
    docs = texts(spark)
    want = {}
    for i, t in docs.items():
        b = t.encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        want[i] = (len(b), len(p), sha(p), zlib.crc32(p[-64:]))
    got = QUERIES["op2_lossless_webp"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want and len(got) == len(docs)


def test_op3(spark):
    """Held-out accuracy, and by language; lang, source and doc_id of a row do not move its prediction."""
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    right = collections.defaultdict(list)
    for r in QUERIES["op3_language_id"](spark, folder).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und":
            right[lang[r.doc_id]].append(r.lang_pred == lang[r.doc_id])
    assert len(right) > 1 and sum(map(len, right.values())) > 250
    assert all(sum(x) / len(x) >= 0.95 for x in right.values()), {k: sum(x) / len(x) for k, x in right.items()}


def test_op6(spark):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in texts(spark).items():
        ids = lib.encode(t)
        want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(lib.decode(ids).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op6_sentencepiece"](spark, SF).collect()} == want


def test_op7(spark):
    data, n = {i: t.encode() for i, t in texts(spark).items()}, 400
    seen = collections.Counter(hash(b[p : p + n]) for b in data.values() for p in range(len(b) - n + 1))
    want = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[hash(b[p : p + n])] > 1:
                gone[p : p + n] = b"\1" * n
        spans = sum(x and (k == 0 or not gone[k - 1]) for k, x in enumerate(gone))
        want[i] = (len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_radix_repeats"](spark, SF).collect()} == want
    assert any(x[1] for x in want.values())


def test_op7_passages(spark):
    """What 50 words cover that also start elsewhere, over the whole table."""
    data = {i: t.encode() for i, t in texts(spark).items()}
    at = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for i, b in data.items()}
    words = {i: [data[i][x:y] for x, y in spans] for i, spans in at.items()}
    seen = collections.Counter(tuple(w[k : k + 50]) for w in words.values() for k in range(len(w) - 49))
    want = {}
    for i, w in words.items():
        gone = bytearray(len(data[i]))
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] > 1:
                x, y = at[i][k][0], at[i][k + 49][1]
                gone[x:y] = b"\1" * (y - x)
        want[i] = (sum(x and (k == 0 or not gone[k - 1]) for k, x in enumerate(gone)), sum(gone))
    assert {r.doc_id: (r.n_passages, r.n_passage_bytes) for r in QUERIES["op7_radix_repeats"](spark, SF).collect()} == want
    assert any(x[1] for x in want.values())


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_op8(spark, folder):
    sets = {}
    for i, t in texts(spark, folder).items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())
    alike = collections.defaultdict(list)
    for i in sorted(sets):
        alike[sets[i]].append(i)
    root = {i: own[0] if s else i for s, own in alike.items() for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = collections.defaultdict(list)
    for s, own in alike.items():
        shared = collections.Counter(j for g in s for j in holders[g])
        for j, both in shared.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(own[0]), find(j)))
                root[b] = a
        for g in s:
            holders[g].append(own[0])
    want = {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op8_minhash_bayes"](spark, folder).collect()}
    assert got == want and any(not x[2] for x in want.values())


def test_op9(spark):
    ids = library_ids(texts(spark), "word_bpe_49k.json", 1)
    got = QUERIES["op9_histogram_packing"](spark, SF).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found, sizes in ((pieces, {i: len(x) for i, x in ids.items()}), (sequences, None)):
        for k, own in found.items():
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
            assert at == sizes[k] if sizes else at <= 2048
    assert set(pieces) == set(ids)
    total = sum(map(len, ids.values()))
    assert len(sequences) <= 1.02 * total / 2048 + 1


def test_op10(spark):
    ids, at, want = library_ids(texts(spark), "byte_bpe_50k.json", 0), 0, {}
    for i in sorted(ids):
        want[i] = (at, len(ids[i]), crc(ids[i]))
        at += len(ids[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_wavelet_shards"](spark, SF).collect()} == want
