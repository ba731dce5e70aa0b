"""Hard negatives, packing and phrases against brute force, on awkward rows and on the smallest tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from boutworks.llm import hard_negatives, packing, phrases
from boutworks.llm._batches import text_array

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i * 7919 % 9973} und so fort," for i in range(12_000))
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two THREE"), (6, "é" * 500 + " 日本語 😀 ▁x"), (7, LONG), (8, LONG), (8, LONG), (None, "no id here"),
    (None, "no id here"), (10, "\x00\x0b\x1c odd\x85 spaces　"), (11, "the same passage " * 40), (13, "=" * 5000), (-5, "negative " * 60), (14, "a<|endoftext|>b <|endoftext|>"),
]


# ---- 11


def brute_negatives(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    """Rows (id, label, vector) of which all take part, in exact integers."""
    rows = sorted({(i, y, tuple(int(np.floor(256 * float(x))) for x in v)) for i, y, v in rows})
    out = []
    for a in rows:
        if not is_anchor(a[0]):
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[2], b[2], strict=False)), b[0], b[1] == a[1]) for b in rows if b != a)
        for s, i, same in [x for x in scored if x[2]][:positives]:
            fit = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a[0], i, k, j, -s, -t) for k, (t, j, _) in enumerate(fit[:negatives], 1)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, y, v if v is None else [x if x is None else float(x) for x in v], 1.0, "x") for i, y, v in rows], "vec_id long, label int, embedding array<double>, norm double, bucket string")


def mined(spark, rows, every, **more):
    return Counter(map(tuple, hard_negatives.mine(vectors(spark, rows), F.col("id") % every == 0, **more).collect()))


@pytest.mark.parametrize("bucket, block, tile", [(1024, 16384, 256), (7, 5, 3)])
def test_hard_negatives(spark, bucket, block, tile, monkeypatch):
    for name, v in (("BUCKET_ROWS", bucket), ("BLOCK_ROWS", block), ("TILE", tile), ("RANGE_ROWS", 40)):
        monkeypatch.setattr(hard_negatives, name, v)
    r = random.Random(3)
    rows = [(i, i % 3, [r.gauss(0, 1) * r.choice([0.01, 1, 1, 30]) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, i % 2, [0.5, 0.25, 0, 0, 1, 0]) for i in range(60)]  # ties by the id
    rows += [(300 + i, 1, [x / 8 for x in range(i % 9)]) for i in range(30)]  # shorter vectors, an empty one
    rows += rows[:20]
    rows += [(3, 1, [1.0] * 6)]  # another row with an id that is taken
    assert mined(spark, rows, 3) == Counter(brute_negatives(rows, lambda i: i % 3 == 0))


def test_large_components_have_exact_scores(spark):
    r = random.Random(5)
    rows = [(i, i % 2, [r.randrange(-(10**6), 10**6) / 4 for _ in range(8)]) for i in range(60)]
    rows += [(100 + i, i % 2, [r.randrange(-(2**21), 2**21) * 1.0 for _ in range(8)]) for i in range(40)]
    assert mined(spark, rows, 2) == Counter(brute_negatives(rows, lambda i: i % 2 == 0))


def test_rows_that_take_no_part(spark):
    ok = [(i, i % 2, [1.0, i / 10]) for i in range(20)]
    odd = [(None, 1, [1.0, 1.0]), (50, None, [1.0, 1.0]), (51, 1, None), (52, 0, [1.0, None]), (53, 0, [float("nan"), 1.0]), (54, 1, [float("inf"), 1.0]), (55, 1, [1e300, 1.0])]
    assert mined(spark, ok + odd, 5) == Counter(brute_negatives(ok, lambda i: i % 5 == 0))
    assert not mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])], 1)  # no other label
    assert not mined(spark, [], 1)


def test_buckets_are_left_out_by_norm(spark, monkeypatch):
    """Small rows behind a large kth score, and below the windows, are never multiplied."""
    rows = hard_negatives.Block(np.array([0]), np.array([0]), np.array([100.0**2]), np.array([[100]]))
    block = lambda ids, labels, x: hard_negatives.Block(np.array(ids), np.array(labels), np.array([float(x) ** 2] * len(ids)), np.array([[x]] * len(ids)))
    tried = []
    real = hard_negatives._scores
    monkeypatch.setattr(hard_negatives, "_scores", lambda a, b: (tried.append(int(b.ids[0])), real(a, b))[1])
    first = hard_negatives.Anchors(rows, True, np.array([0]), np.array([np.iinfo(np.int64).min]), np.array([np.iinfo(np.int64).max]))
    best = first.search([block([1, 2], [0, 0], 50), block([3], [0], 50), block([4], [0], 10)], 2)
    assert best.ids.tolist() == [1, 2] and tried == [1, 3]
    tried.clear()
    then = hard_negatives.Anchors(rows, False, np.array([0]), np.array([4000]), np.array([5000]))
    best = then.search([block([5], [1], 60), block([6], [1], 45), block([7], [1], 30)], 2)
    assert best.ids.tolist() == [6] and tried == [5, 6]


# ---- 12


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTE_BPE)


@pytest.mark.parametrize("long_unit", [1 << 16, 6])
def test_ids_equal_the_library(library, long_unit, monkeypatch):
    monkeypatch.setattr(packing, "LONG_UNIT", long_unit)
    r = random.Random(2)
    signs = [*"abcA é'’sl1 23\n\t \r.,;!<|>-日本。,語  \x85\x1c\x1f　ñ×÷😀，丁", "<|endoftext|>", "'s", "'ll", "  "]
    texts = [t or "" for _, t in ODD] + ["".join(r.choices(signs, k=r.randrange(40))) for _ in range(4000)]
    ids, at = packing.Tokenizer(BYTE_BPE).encode(text_array(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_text_without_white_space(library):
    texts = [str(2**40 + 7) * 20_000, "".join(chr(0x4E00 + i * 37 % 9000) for i in range(50_000)), "ab1" * 100_000]
    ids, at = packing.Tokenizer(BYTE_BPE).encode(text_array(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_worker_forgets(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_IDS", 50)
    tok = packing.Tokenizer(BYTE_BPE)
    for k in range(20):
        tok.encode(text_array(pa.array([f"word{k} other{k} " + "x" * 100 + str(k)])))
        assert len(tok._ids) < 80 and not any(len(u) > packing.KNOWN_BYTES for u in tok._seen)


def test_first_fit_takes_the_first_bin():
    r = random.Random(4)
    for _ in range(30):
        sizes = [r.randint(1, 100) for _ in range(r.randrange(60))]
        room, where = [], []
        for n in sizes:
            b = next((k for k, left in enumerate(room) if left >= n), len(room))
            if b == len(room):
                room.append(100)
            room[b] -= n
            where.append(b)
        assert packing.first_fit(sizes, 100) == (where, [100 - x for x in room])


@pytest.mark.parametrize("room, min_cut", [(2048, 32), (100, 1), (7, 3)])
def test_packs_hold_every_item(room, min_cut):
    r = random.Random(room)
    for n in (0, 1, 2, 50, 500):
        sizes = [r.randrange(room) for _ in range(n)]
        packs = packing.pack(sizes, room, min_cut)
        got = defaultdict(list)
        for pack in packs:
            assert 0 < sum(m for *_, m in pack) <= room and all(m > 0 for *_, m in pack)
            for k, start, m in pack:
                got[k].append((start, m))
        for k, size in enumerate(sizes):
            at = 0
            for start, m in sorted(got[k]):
                assert start == at
                at += m
            assert at == size
        fills = [sum(m for *_, m in p) for p in packs]
        assert all(room - f < min_cut or f & (f - 1) == 0 for f in fills)


def held(spark, docs, library, **more):
    rows = packing.packed(docs, packing.tokenizer_of(BYTE_BPE), **more).collect()
    wanted = Counter()
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        wanted[(doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert total == sum(n * k for (_, n, _), k in wanted.items())
    return rows, wanted, padding / max(1, total)


@pytest.mark.parametrize("group_docs", [4096, 5])
def test_packing(spark, library, group_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(d and d + 10**6, t) for d, t in ODD if d is not None], "doc_id long, text string"))
    docs = docs.dropDuplicates(["doc_id"]).withColumns({"tail": F.lit(1), "GROUP": F.lit("x"), "row": F.lit(2)})
    rows, wanted, padding = held(spark, docs, library, group_docs=group_docs)
    texts = dict(docs.select("doc_id", "text").collect())
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc_id, text in texts.items():
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4"), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    assert padding < 0.01


def test_packing_of_awkward_rows(spark, library):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    rows, wanted, padding = held(spark, docs, library)
    assert padding < 0.01 and sum(r.length for r in rows if r.doc_id is None) == sum(n * k for (d, n, _), k in wanted.items() if d is None)
    assert packing.packed(docs.limit(0), packing.tokenizer_of(BYTE_BPE)).count() == 0


def test_equal_rows_spread_over_groups(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 400, "doc_id long, text string")
    rows = packing.packed(docs, packing.tokenizer_of(BYTE_BPE), group_docs=40).collect()
    per = Counter(r.sequence_id >> 32 for r in rows)
    assert len(per) >= 8 and max(per.values()) < 100 and sum(r.length for r in rows) == 400 * 4


# ---- 13

FOLD = {c: c + 32 for c in range(65, 91)}


def brute_phrases(rows, longest=5, min_count=100, top=2000, cover=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in [("und" if lang is None else lang, text) for lang, text in rows]:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(FOLD)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        fit = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        covered = set()
        for p, a in fit.items():
            for k in range(2, len(p)):
                covered |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= cover * fit[p[i : i + k]]}
        scored = []
        for p, a in fit.items():
            if p not in covered:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return out


def text_rows(spark, rows):
    return spark.createDataFrame([(lang, t, "x", 1) for lang, t in rows], "lang string, text string, phrase string, A int")


def test_phrases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    for few, top, cover in ((12, 2000, 100), (5, 40, 80)):
        got = phrases.collocations(docs, min_count=few, top=top, cover=cover).collect()
        assert Counter(map(tuple, got)) == Counter(brute_phrases(rows, 5, few, top, cover)) and len(got) > 50


@pytest.mark.parametrize("bits, chunk", [(1 << 29, 4 << 20), (1 << 16, 50)])
def test_phrases_of_awkward_rows(spark, bits, chunk, monkeypatch):
    monkeypatch.setattr(phrases.frequent_filter, "__defaults__", (bits,))
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    r = random.Random(6)
    rows = [(None, None), ("en", ""), ("en", " \t. ,\n"), (None, "New  York\tNew York."), ("und", "new york, NEW YORK"), ("", "é日本 x. é日本 x"), ("en", "x" * 20_000), ("en", LONG)]
    rows += [(r.choice(["en", "de", None]), "".join(r.choice("abcd") + r.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b"]) for _ in range(60))) for _ in range(30)]
    rows += [("en", "the very common words stand here")] * 150
    for few in (2, 10):
        got = phrases.collocations(text_rows(spark, rows), min_count=few).collect()
        assert Counter(map(tuple, got)) == Counter(brute_phrases(rows, min_count=few))
    assert phrases.collocations(text_rows(spark, []), min_count=2).count() == 0


def test_full_filter_loses_nothing(spark):
    """A filter whose bits are all set lets every phrase pass; counts and the threshold stay exact."""
    rows = text_rows(spark, [("en", "a b c d a b c x y z")] * 3).select("lang", "text")
    full = np.full(1 << 13, 255, dtype=np.uint8)
    got = {(r.phrase, r.a) for r in phrases.level_counts(rows, 2, full).collect()}
    assert got == {("a b", 6), ("b c", 6), ("c d", 3), ("d a", 3), ("c x", 3), ("x y", 3), ("y z", 3)}
    none = np.zeros(1 << 13, dtype=np.uint8)
    assert phrases.level_counts(rows, 2, none).count() == 0


def test_filters_have_no_false_negatives(spark):
    level = spark.createDataFrame([("en", f"w{i} x{i}", 100) for i in range(5000)], "lang string, phrase string, a long")
    for most in (1 << 29, 1 << 17):
        bits = phrases.frequent_filter(level, 2, most)
        assert len(bits) * 8 <= most
        words = phrases.Words(text_array(pa.array([f"w{i} x{i}" for i in range(10_000)])), pa.array(["en"] * 10_000, pa.large_string()))
        held_ = phrases._held(bits, words.hashes(2))[np.flatnonzero(words.room == 2)]
        assert held_[:5000].all() and (most < 1 << 29 or held_[5000:].mean() < 0.05)


def test_large_scores_are_exact(spark):
    """Products beyond 64 bits: the SQL of the score on made-up counts."""
    a, n, left, right = 10**12, 7 * 10**14, 10**13 + 3, 10**12 + 1
    big = lambda v: f"cast({v} as decimal(15,0))"
    assert spark.sql(f"select (cast(1000 as decimal(4,0)) * {big(a)} * {big(n)}) div ({big(left)} * {big(right)})").first()[0] == 1000 * a * n // (left * right)
