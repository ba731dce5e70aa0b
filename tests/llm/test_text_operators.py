"""Text operators against brute force, on awkward rows and on the smallest tables."""

import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from boutworks.llm import _xxh64, decontamination, kneser_ney, quality_rules, queries, sentencepiece_bpe, simhash, substring_dedup
from boutworks.llm._batches import text_array
from boutworks.runtime import shared_dir

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"w{i * 7919 % 9973} und so fort" for i in range(12_000))

ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two THREE"), (5, "a b c a b c a b c\nx\nx\n \nx "), (6, "é" * 500 + " 日本語 😀 ▁x ▁ ▁"),
    (7, LONG), (8, LONG), (8, LONG), (None, "no id at all here"), (None, "no id at all here"), (9, LONG[:5000] + "#" + LONG[5000:]), (10, "\x00\x0b\x1c odd\x85 spaces　"),
    (11, "the same passage " * 40), (12, "before. " + "the same passage " * 40), (13, "=" * 5000), (-5, "negative " * 60),
]


def documents(spark, rows=ODD):
    """Rows with extra columns whose names clash with outputs and helpers."""
    return spark.createDataFrame([(d, t, "kept", 7, "x") for d, t in rows], "doc_id long, text string, kept string, N_WORDS int, _key string")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(small):
    return [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(tuple, rows))


# ---- 2


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(spark, small, library):
    rng = random.Random(1)
    made = ["".join(rng.choices("aetinos ▁  \n\r\t.,|$éö日😀=-_#01", k=rng.randint(1, 120))) for _ in range(600)]
    made += [" " * 77 + "x" + " " * 33, "a" * 1000, "ab" * 777, "=-" * 400, "日本語" * 200, "<s></s><unk><0x0A>"]
    docs = documents(spark, ODD + [(100 + i, t) for i, t in enumerate(made)] + rows_of(small))
    coded = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, PIECES), PIECES)
    for r in coded.collect():
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == library.decode(want)
    assert coded.columns == [*docs.columns, "ids", "decoded"]


def test_piece_digests(spark, library):
    got = sentencepiece_bpe.digests(documents(spark), PIECES).collect()
    want = []
    for d, t in ODD:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert bag(got) == bag(want)
    assert sentencepiece_bpe.digests(documents(spark).limit(0), PIECES).count() == 0


# ---- 3


def brute_counts(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) for k in range(3) if seen[tuple(words[i : i + 3])] > 1}
    lines, dup, n = set(), 0, 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            n += 1
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), n


def test_rule_statistics(spark, small):
    docs = documents(spark, ODD + rows_of(small))
    got = quality_rules.rule_statistics(docs)
    assert bag((r.doc_id, r.text, *(r[c] for c in quality_rules.COUNTS)) for r in got.collect()) == bag((d, t, *brute_counts(t)) for d, t in ODD + rows_of(small))
    assert [c for c in got.columns if c.lower() == "n_words"] == ["n_words"]


def test_verdicts(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality_rules.verdicts(small, labels).collect()}
    assert len(got) == small.count()
    for d, t in rows_of(small):
        n, chars, symbols, dup, repeat, _ = brute_counts(t)
        failed = n < 50 or 100 * repeat > 50 * n
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        assert not (failed and r.kept)
    judged = [(r.quality, got[r.doc_id]) for r in labels.collect() if not got[r.doc_id].base_failed]
    good, bad = [r.kept for q, r in judged if q], [r.kept for q, r in judged if not q]
    assert sum(good) / len(good) >= 0.99 and (not bad or sum(bad) / len(bad) <= 0.2)


def test_forest_against_plain_path_lengths():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    forest = quality_rules.grow_forest(x, trees=20, tree_rows=64)

    def depth(row):
        total = 0.0
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] + (row[forest.feature[at]] >= forest.split[at])
            total += forest.split[at]
        return 2 ** (-total / len(forest.roots) / quality_rules._expected(forest.tree_rows))

    probe = np.vstack([x[:20], [[9, 9, 9, 9.0]]])
    assert forest.scores(probe) == pytest.approx([depth(r) for r in probe])
    assert forest.scores(probe)[-1] > forest.scores(x).mean()


def test_without_labels_nothing_but_the_base_rejects(spark, small):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.verdicts(small, none).where("kept = base_failed").count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (12345, 1, 1), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.verdicts(documents(spark), odd).count() == len(ODD)
    assert quality_rules.verdicts(documents(spark).limit(0), odd).count() == 0


def test_forest_is_fitted_on_all_labelled_rows(spark):
    """More labelled rows than the 20,000 that the fit once took: each is in a tree, and the threshold is that of them all."""
    n = 24_000
    word = "concat(substr('abcdefghijklm', 1, cast(1 + pmod(xxhash64(id, k), 13) as int)), if(pmod(xxhash64(k, id), 40) < pmod(id, 9), '#', ''), k)"
    docs = spark.range(n).selectExpr("id as doc_id", f"array_join(transform(sequence(1, 50 + cast(id % 7 as int)), k -> {word}), ' ') as text").cache()
    labels = docs.selectExpr("doc_id", "cast(pmod(xxhash64(doc_id), 10) > pmod(doc_id, 9) as int) as quality", "0 as toxic")
    forest = quality_rules.fit_forest(docs, labels)
    rows = quality_rules.labelled_rows(quality_rules.rule_statistics(docs), labels).toPandas()
    assert len(rows) == n
    score, good = forest.scores(rows[quality_rules.FEATURES].to_numpy()), rows["good"].to_numpy()
    cuts = np.unique(score[good])
    own, bad = (np.searchsorted(np.sort(score[g]), cuts, side="right") for g in (good, ~good))
    gain = own * int((~good).sum()) - bad * int(good.sum())
    best = cuts[len(cuts) - 1 - int(np.argmax(gain[::-1]))]
    assert forest.threshold == pytest.approx((best + score[score > best].min()) / 2 if (score > best).any() else best, rel=1e-12)
    kept = quality_rules.labelled_rows(quality_rules.rule_statistics(docs), labels).where("good")
    ids = kept.withColumn("f_length", F.col("doc_id").cast("double"))
    for size in (int(good.sum()), 10**9):  # with many more rows than the trees ask for, each row is in one tree
        trees = defaultdict(list)
        for tree, doc in quality_rules.dealt_to_trees(ids, size).select("tree", "f_length").toPandas().itertuples(index=False):
            trees[doc].append(tree)
        assert len(trees) == good.sum() and all(len(set(t)) == len(t) for t in trees.values())
        assert max(map(len, trees.values())) == min(quality_rules.TREES, -(-quality_rules.TREES * quality_rules.TREE_ROWS // size))


# ---- 7


def brute_kneser_ney(rows, order=kneser_ney.ORDER):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in rows]
    grams = lambda t: [tuple([0] * (order - 1) + t)[k : k + order] for k in range(len(t))]
    single = Counter(w for h, t in zip(held, tokens, strict=True) if not h for w in t)
    count = {order: Counter(g for h, t in zip(held, tokens, strict=True) if not h for g in grams(t))}
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    n, v, bigrams = sum(single.values()), len(single), len(count[2])

    def discounts(counts):
        m = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if not all(m):
            return [0, 0.5, 1.0, 1.5]
        y = m[0] / (m[0] + 2 * m[1])
        return [0, *(min(max(x, 0), k) for k, x in enumerate((1 - 2 * y * m[1] / m[0], 2 - 3 * y * m[2] / m[1], 3 - 4 * y * m[3] / m[2]), 1))]

    d = {k: discounts(c) for k, c in count.items()}
    total, free = Counter(), Counter()
    for k in range(2, order + 1):
        for g, c in count[k].items():
            total[g[:-1]] += c
            free[g[:-1]] += d[k][min(c, 3)]
    rest = sum(d[1][min(c, 3)] for c in count[1].values()) / bigrams if bigrams else 1.0

    @functools.cache
    def p(g):
        c = count[len(g)].get(g, 0)
        if len(g) == 1:
            return (max(c - d[1][min(c, 3)], 0) / bigrams if bigrams else 0) + rest / (v + 1)
        low = p(g[1:])
        return (max(c - d[len(g)][min(c, 3)], 0) + free[g[:-1]] * low) / total[g[:-1]] if total[g[:-1]] else low

    out = []
    for (doc, _), h, t in zip(rows, held, tokens, strict=True):
        base = sum(math.log10((single.get(w, 0) + 1) / (n + v + 1)) for w in t)
        out.append((doc, h, len(t), sum(w in single for w in t), n, base, sum(math.log10(p(g)) for g in grams(t))))
    return out


@pytest.mark.parametrize(("source", "order"), [("odd", 3), ("table", 3), ("table", 2), ("odd", 4), ("one", 3), ("none", 3)])
def test_language_model(spark, small, source, order):
    rows = {"odd": ODD, "table": rows_of(small), "one": [(3, "A b a b")], "none": []}[source]
    docs = documents(spark, rows) if rows else documents(spark).limit(0)
    got = kneser_ney.report(docs, order).collect()
    want = brute_kneser_ney(rows, order)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(([*r][:7] for r in got), key=key), sorted(map(list, want), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    if source == "table":
        held = [r for r in got if r[1]]
        assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_the_query_reads_two_words_back(spark, tmp_path):
    """The word after the next depends on the first one of three, which bigrams can't see."""
    rng = random.Random(7)
    texts = [" ".join(f"{w} the {w.upper()}x{rng.randrange(2)}" for w in rng.choices(["red", "Green", "blue", "grey"], k=12)) for _ in range(60)]
    rows = list(enumerate(texts))
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op7_kneser_ney(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({r[0]: r[6] for r in brute_kneser_ney(rows, 3)}, rel=1e-9)
    pairs = {r[0]: r[6] for r in brute_kneser_ney(rows, 2)}
    assert all(got[d] > pairs[d] + 5 for d in got)


def test_values_beyond_a_byte():
    table = np.array([[0, 254, 255], [256, 7, 2**40], [1, 255, 3]])
    raw = kneser_ney._narrow(table)
    for rows in ([0, 1, 2], [2], [1, 1, 0]):
        assert kneser_ney._widened(raw, 3, 3, np.array(rows)).tolist() == table[rows].tolist()


def test_large_counts_are_exact(spark):
    rows = [(0, "x y " * 1000), (1, "x y"), (2, "y x z")]
    got = {r.doc_id: r.score for r in kneser_ney.report(documents(spark, rows)).collect()}
    assert got == pytest.approx({r[0]: r[6] for r in brute_kneser_ney(rows)}, rel=1e-9)


def test_counts_beyond_32_bits(tmp_path):
    """Counts of a range that add up to more than 2 ** 32 reach the words unchanged."""
    words = [np.array([5, 6, 6], np.uint64), np.array([7, 7, 9], np.uint64)]
    block = kneser_ney._pack(words, [np.array([3_000_000_000, 5_000_000_000, 1], np.int64)])
    rows = lambda blocks: [kneser_ney._block_batch([(0, b) for b in blocks])]
    merged = [r for b in kneser_ney._merge(str(tmp_path), 2, True, 1)(rows([block, block])) for r in b.to_pylist()]
    assert merged[0]["total"] == 16_000_000_002
    passed = [r["block"] for r in merged[1:]]
    last = [r for b in kneser_ney._merge(str(tmp_path), 1, False, 1)(rows(passed)) for r in b.to_pylist()]
    assert last[0]["total"] == 16_000_000_002
    key, stats = kneser_ney._load(f"{tmp_path}/1-0.key.npy"), kneser_ney._load(f"{tmp_path}/1-0.n.npy").reshape(-1, 6)
    assert dict(zip(key.tolist(), stats[:, 5].tolist(), strict=True)) == {5: 0, 6: 0, 7: 16_000_000_000, 9: 2}


def test_words_are_hashed_together(monkeypatch):
    """Words of up to 512 bytes have no call of their own; equal words, and no others, have equal hashes."""
    rng = random.Random(5)
    words = ["a", "a\x00", "\x00a", "\x00", "\x00\x00", "é" * 4, "日本語", *("x" * n for n in (7, 8, 9, 15, 16, 17, 511, 512, 513)), *("".join(rng.choices("ab", k=n)) for n in range(1, 40))]
    texts = [" ".join(rng.choices(words, k=400)).upper() if k % 2 else "\t".join(words) for k in range(6)] + ["", " ", "x" * 513]
    alone = []
    monkeypatch.setattr(kneser_ney.xxhash, "xxh64_intdigest", lambda raw, seed: alone.append(len(raw)) or 77)
    hashes, tokens, ends = kneser_ney.tokens_of(pa.array([t.encode() for t in texts], pa.large_binary()))
    assert set(alone) == {513}
    want = [[*WORD.findall(t.translate(LOWER)), None] for t in texts]
    assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    flat = [w for t in want for w in t]
    pairs = set(zip(flat, hashes[tokens].tolist(), strict=True))
    assert len(pairs) == len(set(flat)) == len({h for _, h in pairs}) == len(hashes) and (None, int(kneser_ney.END)) in pairs


@pytest.mark.parametrize("kinds", [30, 3_000_000])
def test_counts_of_word_places(kinds):
    """Chunks with words of their own are counted as one; of many words, three don't fit in 64 bits."""
    rng = np.random.default_rng(4)
    held, want = [], Counter()
    for k in range(3):
        numbers = np.concatenate([[0], rng.permutation(kinds)[: kinds - 7] + 1]).astype(np.uint32)
        places = [np.minimum(rng.zipf(1.3, 2000), kinds - 7).astype(np.uint32) for _ in range(3)]
        held.append((numbers, places))
        want.update(zip(*(numbers[c].tolist() for c in places), strict=True))
    words, count = kneser_ney._tallied(held)
    assert dict(zip(zip(*(w.tolist() for w in words), strict=True), count.tolist(), strict=True)) == want
    assert words[0].tolist() == sorted(words[0].tolist())


def test_training_leaves_its_arrays_alone(spark, small):
    """Shuffles and blocks are deleted step by step, so the disk never holds those of all orders."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n.rsplit("/", 1)[-1] for n in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    tables = lambda: set(Path(shared_dir(spark).removeprefix("file://")).glob("boutworks/*"))
    before, there = shuffles(), tables()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    model = kneser_ney.train(documents(spark, rows_of(small)))
    assert spark.conf.get(name, None) == setting
    for _ in range(50):  # Spark deletes in the background
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert {p.name.rsplit("-", 1)[0] for p in tables() - there} == {"ngrams", "merged"} and model.tokens > 0


def test_ranges_that_can_t_be_mapped_are_bounded(monkeypatch, tmp_path):
    for k in range(9):
        kneser_ney._save(f"{tmp_path}/{k}.key.npy", np.arange(1000, dtype=np.uint64))
        kneser_ney._save(f"{tmp_path}/{k}.n.npy", np.arange(1000, dtype=np.uint8))
    load = kneser_ney._load
    monkeypatch.setattr(kneser_ney, "_load", lambda path: np.array(load(path)))
    monkeypatch.setattr(kneser_ney, "HELD_BYTES", 30_000)
    ranges = kneser_ney._Ranges()
    for k in (0, 1, 2, 3, 4, 0, 5, 6, 7, 8):
        assert len(ranges.get(f"{tmp_path}/{k}")[0]) == 1000 and ranges.held <= 30_000


# ---- 8


def test_xxh64_equals_the_library():
    rng = random.Random(2)
    raw = bytes(rng.randrange(256) for _ in range(4000))
    spans = [(rng.randrange(3000), n) for n in [*range(0, 70), 100, 255, 256, 511, 512, 513, 900] for _ in range(9)]
    flat = np.frombuffer(raw, np.uint8)
    got = _xxh64.xxh64(flat, np.array([s for s, _ in spans]), np.array([n for _, n in spans]), 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[s : s + n], 42) for s, n in spans]


def brute_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    u = sorted(set(prints))
    parent = {x: x for x in u}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(u):
        for y in u[i + 1 :]:
            if (x ^ y).bit_count() <= 4:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return [find(x) for x in prints]


def test_fingerprints(small):
    texts = [t for _, t in ODD + rows_of(small)] + [LONG.upper(), "É é " * 300]
    got = simhash.fingerprints_of(text_array(pa.array(texts)))
    assert got.tolist() == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("block", [4096, 8])
def test_near_duplicates(spark, small, block):
    words = [LONG.split()[i : i + 400] for i in range(0, 4000, 400)]
    rng = random.Random(6)
    near = []
    for w in words:
        for _ in range(8):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    rows = ODD + rows_of(small) + [(10_000 + i, t) for i, t in enumerate(near)]
    got = simhash.near_duplicates(documents(spark, rows), block=block).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(prints)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    assert bag(got) == bag((d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, root, strict=True))
    assert len(set(root)) < len(set(prints))


def test_dense_balls_link_completely():
    rng = np.random.default_rng(4)
    fp = np.unique(np.uint64(0xABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)))
    key = np.zeros(len(fp), np.int64)
    u, v = simhash._link_groups(key, key, fp)
    assert len(u) < len(fp)
    assert all((int(a) ^ int(b)).bit_count() <= 64 for a, b in zip(u, v, strict=True))


def test_chains_lose_no_link(spark):
    """Every two fingerprints of at most 4 differing bits meet in a key whose chain budgets they keep."""
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b), dtype=np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in np.concatenate([a, b]).view(np.int64)], "fp long")
    keys = defaultdict(set)
    for r in simhash.chain_keys(nodes).collect():
        keys[r.fp & (1 << 64) - 1].add(r.k)
    pairs = [(x, y, k) for x, y in zip(a.tolist(), b.tolist(), strict=True) for k in keys[x] & keys[y]]
    x, y, k = (np.array(c, dtype=t) for c, t in zip(zip(*pairs, strict=True), (np.uint64, np.uint64, np.int64), strict=True))
    assert len(set(x[simhash._pigeonring(x, y, k)].tolist())) == len(set(a.tolist()))


def brute_set(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_similar(texts):
    """The first row of each row's group: links are shingle sets of a Jaccard similarity of 0.8 or more."""
    sets = [brute_set(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(words, changes, rng):
    v = list(words)
    for at in rng.sample(range(len(v)), changes):
        v[at] = f"changed{rng.randrange(999)}"
    return " ".join(v)


@pytest.mark.parametrize("block", [2048, 3])
def test_similar_groups(spark, small, block):
    rng = random.Random(8)
    base = [[f"x{rng.randrange(3000)}" for _ in range(n)] for n in (40, 60, 120, 400, 1500) for _ in range(4)]
    near = [edited(w, round(len(w) * share), rng) for w in base for share in (0, 0.005, 0.01, 0.02, 0.021, 0.03, 0.05)]
    near += [" ".join(w[:k]) for w in base[:8] for k in (4, 5, 6, 30, 33, 37)]
    rows = [(i, t) for i, t in enumerate([t for _, t in ODD + rows_of(small)] + near)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, rows), block=block).collect()}
    assert got == dict(enumerate(brute_similar([t for _, t in rows])))
    assert len(set(got.values())) < len(set(t for _, t in rows)) - 40


def test_similar_sets_of_distant_fingerprints(spark):
    """Pairs of 14 and 13 shingles, 12 of them common: a similarity of exactly 0.8."""
    texts = []
    for i in range(2000):
        words = [f"p{i}w{k}" for k in range(19)]
        texts += [" ".join(words[:18]), " ".join([words[18], *words[:16]])]
    fp = simhash.fingerprints_of(pa.array(texts, pa.large_string()), simhash.WIDE_SHINGLE)
    assert (np.bitwise_count(fp[::2] ^ fp[1::2]) > 18).any()
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, list(enumerate(texts)))).collect()}
    assert got == {i: i - i % 2 for i in range(4000)}


def test_linked_sets_equal_all_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(np.append(rng.choice(60, rng.integers(20, 40), replace=False), 1000 + rng.integers(0, 3, 2))).astype(np.uint64) for _ in range(60)]
    sets += [np.append(np.delete(s, k), np.uint64(5000)) for s in sets[:20] for k in (0, 3, 7)] + [sets[0][:0]]
    u, v = simhash.link_sets(np.arange(len(sets)), np.concatenate(sets), np.array([len(s) for s in sets]))
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len(x) and 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))]
    a, b = (np.array(x) for x in zip(*links, strict=True))
    roots = [dict(zip(*(x.tolist() for x in simhash.spanning_forest(*p)), strict=True)) for p in ((u, v), (a, b))]
    assert roots[0] == roots[1] and len(u) == len(roots[0]) < len(links)


def test_keep_one(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len(set(brute_similar([t for _, t in ODD])))
    assert sum(r.doc_id == 8 for r in got) == 0 and sum(r.doc_id == 7 for r in got) == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# ---- 9

ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in rows:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                own = windows.get(tuple(w[k : k + n])) if k + n <= len(w) else None
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        names = sorted({str(i) for i in found if i is not None})
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "und so fort"), (2, " ".join(LONG.split()[40:70])), (10, "The same passage the same passage the same passage the same passage"), (None, "odd spaces"), (3, None), (4, "!!"), (5, "negative"), (5, "one"), (6, "Never seen anywhere at all")]


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination(spark, small, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    items = ITEMS + [(r.item_id, r.text) for r in bench.collect()][:4]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    rows = ODD + rows_of(small)
    found = decontamination.find_matches(documents(spark, rows).select("doc_id", "text"), table, block_bytes=block)
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.hit_spans), len(r.hit_items), hashlib.sha256(",".join(r.hit_items).encode()).hexdigest(), bool(r.hit_spans)) for r in found.collect()]
    assert bag(got) == bag(brute_contamination(rows, items))
    longest = {r.text: r.longest_match for r in found.collect()}
    assert longest[LONG] == 30 and longest[None] == 0 and longest["one"] == 1


def test_test_blocks_come_one_at_a_time(spark, monkeypatch):
    """A block's hits are written before the next block is collected."""
    events = []
    block, path = decontamination._test_block, decontamination.work_path
    monkeypatch.setattr(decontamination, "_test_block", lambda *a: events.append("collected") or block(*a))
    monkeypatch.setattr(decontamination, "work_path", lambda *a: events.append("written") or path(*a))
    table = spark.createDataFrame([(i, f"item number {i} of the test set") for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "an item number 3 of the test set here"), (2, "nothing")], "doc_id long, text string")
    assert {r.doc_id: r.hit_items for r in decontamination.find_matches(docs, table, block_bytes=100).collect()} == {1: ["3"], 2: []}
    assert len(events) > 6 and events == ["collected", "written"] * (len(events) // 2)


def test_contamination_without_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark)
    assert decontamination.contamination(docs, none).where("contaminated").count() == 0
    assert decontamination.remove_contaminated(docs.select("doc_id", "text"), none).count() == len(ODD)
    assert decontamination.contamination(docs.limit(0), none).count() == 0


# ---- 10


def test_anchors_don_t_depend_on_the_chunk(monkeypatch):
    """With a hash so narrow that ties are common, equal windows have equal anchors in chunks of any length."""
    whole = substring_dedup._hashes
    monkeypatch.setattr(substring_dedup, "_hashes", lambda flat: whole(flat) & np.uint64(0xF))
    monkeypatch.setattr(substring_dedup, "_MUL", np.where(np.arange(12) == 11, np.uint64(1 << 36 | 1), substring_dedup._MUL))
    rng = np.random.default_rng(3)
    piece = rng.integers(97, 123, 400, dtype=np.uint8)

    def anchors(before, after):
        flat = np.concatenate([rng.integers(97, 123, before, dtype=np.uint8), piece, rng.integers(97, 123, after, dtype=np.uint8)])
        r = substring_dedup.runs(flat, np.array([0, len(flat)]))
        at = {int(s) + k: int(a) for s, e, a in zip(r["s"], r["e"], r["a"], strict=True) for k in range(int(e - s) + 1)}
        return [at[before + k] - before for k in range(201)]

    first = anchors(0, 0)
    assert all(anchors(n, m) == first for n, m in [(0, 3000), (500, 70_000), (70_000, 9), (1_200_000, 1_200_000)])


def test_digests_of_runs_cover_all_bytes():
    rng = np.random.default_rng(4)
    flat = rng.integers(97, 123, 1000, dtype=np.uint8)
    r = substring_dedup.runs(flat, np.array([0, 1000]))
    for k, (s, e) in enumerate(zip(r["s"].tolist(), r["e"].tolist(), strict=True)):
        other = flat.copy()
        other[(s + e + 200) // 2] ^= 1
        r2 = substring_dedup.runs(other, np.array([0, 1000]))
        assert (r["bh"][k], r["ch"][k]) not in set(zip(r2["bh"].tolist(), r2["ch"].tolist(), strict=True))


def brute_repeats(rows, width=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [12 << 20, 3000])
def test_repeats(spark, small, bucket, monkeypatch):
    """Small buckets put most groups on a boundary."""
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    rng = random.Random(9)
    passages = ["".join(rng.choices("abcd ", k=rng.choice([199, 200, 201, 260, 500]))) for _ in range(6)]
    rows = [(i, "".join(rng.choice([*passages, "".join(rng.choices("abcd é", k=rng.randint(0, 150)))]) for _ in range(rng.randint(1, 6)))) for i in range(1000, 1120)]
    rows += [(d, t if t is None or len(t) < 20_000 else t[:20_000]) for d, t in ODD] + rows_of(small)[:120]
    got = substring_dedup.report(documents(spark, rows))
    assert bag(got.collect()) == bag(brute_repeats(rows))


def test_repeats_keep_whole_characters(spark):
    same = "é" * 150
    rows = [(1, "x" + same), (2, "é" + same + "y"), (3, None)]
    got = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert got == {1: "x", 2: "y", 3: ""}
    assert substring_dedup.report(documents(spark).limit(0)).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 2, (500, 24), dtype=np.uint8)
    order = substring_dedup.multikey_order(grid)
    assert [bytes(r) for r in grid[order]] == sorted(bytes(r) for r in grid)


# ---- the pipeline, stage by stage against brute force


def test_pipeline(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "SentencePiece"]
    docs = small.withColumns({"kept": F.lit(1), "fp": F.lit("x"), "n_words": F.lit(2), "_spans": F.lit(3)})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, docs, SF).cache()
    assert kept.columns == docs.columns
    verdict = {r.doc_id for r in quality_rules.verdicts(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdict
    rows = rows_of(kept)
    alone = stage["SimHash near-dedup"](spark, kept, SF).cache()
    assert alone.columns == docs.columns
    least = {}
    for (d, _), r in zip(rows, brute_similar([t for _, t in rows]), strict=True):
        least[r] = min(d, least.get(r, d))
    assert {r.doc_id for r in alone.collect()} == set(least.values())
    rows = rows_of(alone)
    cut = stage["suffix-array dedup"](spark, alone, SF).cache()
    assert cut.columns == docs.columns
    assert {r.doc_id: len((r.text or "").encode()) for r in cut.collect()} == pytest.approx({d: n - gone for d, n, gone, *_ in brute_repeats(rows)}, abs=12)
    clean = stage["benchmark decontamination"](spark, cut, SF).cache()
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, *_, hit in brute_contamination(rows_of(cut), items) if not hit}
    last = stage["SentencePiece"](spark, clean, SF)
    assert last.count() == clean.count()
    assert bag(last.collect()) == bag(corpus_pipeline.run(spark, SF).collect())


def test_pipeline_stages_take_awkward_rows(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (ODD, []):
        docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= len(rows), name
            if name != "SentencePiece":
                assert out.columns == docs.columns, name


def test_queries_are_named_by_number():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in queries.queries() and set(queries.oracle_sql()) <= set(queries.queries())


def test_long_segments_equal_the_library(library):
    r = random.Random(9)
    model = sentencepiece_bpe.BpeModel.parse(open(PIECES, "rb").read())
    texts = ["".join(r.choices("abcdeABtheingon01éñ日本", k=r.randrange(600))) for _ in range(200)]
    texts += ["".join(r.choices(r.sample("abcdefghijklmnopqrstuvwxyz", 3), k=r.randrange(100, 500))) for _ in range(200)]
    texts += ["the" * 300, "a" * 5000, "ing" * 1000 + "x", "-" * 999 + "a" * 999, "".join(LONG.split())[:60_000]]
    ids, ends = model.encode(text_array(pa.array(texts)))
    starts = np.concatenate([[0], ends[:-1]])
    assert [ids[a:b].tolist() for a, b in zip(starts, ends, strict=True)] == [[1, *x, 2] for x in library.encode(texts, num_threads=1)]


def test_a_million_characters_without_white_space(library):
    r = random.Random(10)
    text = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    model = sentencepiece_bpe.BpeModel.parse(open(PIECES, "rb").read())
    began = time.time()
    ids, ends = model.encode(text_array(pa.array([text])))
    assert time.time() - began < 20
    assert ids.tolist() == [1, *library.encode(text), 2]
    assert len(model._ids) == 0  # nothing of long segments is kept


def test_a_window_that_all_items_share(monkeypatch):
    """Items and longest matches don't depend on how items are cut into blocks."""
    head = "you are given a text read it and answer all questions below"
    items = [(f"i{k}", f"{head} {k} {k + 1} {k + 2} tail of the item") for k in range(60)]
    texts = text_array(pa.array([f"{head} {k} {k + 1} {k + 2} tail {head}" if k % 2 else head for k in range(40)]))
    made = decontamination.build_test_set(items, 10)
    whole = decontamination._match(texts, made, 10)
    monkeypatch.setattr(decontamination, "PLACES", 7)
    parts = decontamination._match(texts, made, 10)
    assert [sorted(x) for x in parts.items] == [sorted(x) for x in whole.items] and len(whole.items[0]) == 60
    assert parts.longest.tolist() == whole.longest.tolist() and whole.longest[1] > whole.longest[0] == 12


def test_equal_rows_have_one_context(spark, monkeypatch):
    shared = "this passage is shared by the two texts and it is long enough to be found " * 4
    rows = [(i, "first " * 50 + shared + "x") for i in [1] * 500] + [(2, "other words before " * 20 + shared + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    contexts = []
    real = substring_dedup._contexts
    monkeypatch.setattr(substring_dedup, "_contexts", lambda *a: (contexts.append(real(*a)), contexts[-1])[1])
    got = bag(substring_dedup.report(docs).collect())
    assert contexts[0].count() < 60
    assert sum(got.values()) == 501 and len(got) == 2


def test_any_column_travels_along(spark):
    names = ["_id", "_row", "_keep_id", "_r1", "_r2", "_spans", "_text", "_all", "_others", "c0"]
    rows = [(d, t, *[d or 0] * len(names), {"k": d or 0}) for d, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names) + ", m map<string,long>")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and all(r.m == {"k": r.doc_id or 0} and r._id == (r.doc_id or 0) for r in kept.collect())
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == [*docs.columns, "removed_spans", "kept_bytes", "kept_text"] and cut.count() == len(ODD)
    assert all(r._r1 == r._spans == (r.doc_id or 0) for r in cut.collect())
