"""Periodic runs, SimHash components and hard negatives against brute force, on planted cases and on hard tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallygraph.llm import negatives, periodic, simhash
from tallygraph.llm import queries as llm_queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (4, "b a b a b a b a"), (None, "same words here " * 10), (None, None), (6, "same words here " * 10), (7, "x " * 40_000), (8, "‰§¶ 12!"), (9, "x" * 70_000), (10, "A\nA\n\nA A\rA A"), (11, "Same WORDS here " * 10)]


def hard_table(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in HARD], "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("z") for c in ("fp", "runs", "n", "a", "b", "label", "anchor", "point", "c", "best", "collapsed", "component_id")})


# ---- periodic runs


def brute_runs(words):
    n, out = len(words), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p):
                part = words[i : i + length]
                if next(q for q in range(1, p + 1) if part[q:] == part[:-q]) == p:
                    out.add((i, length, p))
            i = j + 1 if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs))


def periodic_text(rng):
    words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        block = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
        words += (block * rng.randint(2, 9))[: rng.randint(1, 200)]
        words += [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 5))]
    return " ".join(words)


@pytest.mark.parametrize("base,rate", [(periodic.PAIR_BASE, periodic.PAIR_RATE), (0, 0.0), (60, 0.01)])
def test_runs_equal_brute_force(monkeypatch, base, rate):
    """By pairs alone, by FFT alone, and by both."""
    import pyarrow as pa

    monkeypatch.setattr(periodic, "PAIR_BASE", base)
    monkeypatch.setattr(periodic, "PAIR_RATE", rate)
    rng = random.Random(5)
    texts = [periodic_text(rng) for _ in range(150)] + ["", "a", "a " * 6, "a " * 5, "a b " * 4, "a b " * 3 + "a"]
    n, runs, collapsed = periodic._analyse(pa.array(texts), 6, 4)
    for text, count, got, rest in zip(texts, n.to_pylist(), runs.to_pylist(), collapsed.to_pylist()):
        words = text.split()
        want = brute_runs(words)
        assert count == len(words) and [(r["start"], r["length"], r["period"]) for r in got] == want
        assert rest == brute_collapse(words, want)


def test_lag_counts_of_a_long_text():
    rng = np.random.default_rng(3)
    words = rng.zipf(1.3, 6000).astype(np.uint64) % np.uint64(500)
    row, begin, top = np.zeros(6000, np.int64), np.array([0, 6000]), np.array([1500])
    codes, order, bounds = periodic.word_codes(words, row)
    assert (np.diff(bounds) ** 2 > periodic.PAIR_BASE + 0.3 * 8192 * 13).any()  # some words go by FFT
    count, _ = periodic.lag_counts(order, bounds, row, begin, top)
    for p in (1, 2, 7, 63, 1499, 1500):
        assert count[p] == int((words[p:] == words[:-p]).sum())
    assert all((codes[i] == codes[j]) == (words[i] == words[j]) for i, j in rng.integers(0, 6000, (200, 2)))


def test_islands_are_found_between_samples():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 50, 3000)
    codes[317 : 317 + 450] = np.resize(rng.integers(0, 50, 97), 450)
    (b, e), *more = periodic.islands(codes, 97, 3 * 97)
    assert not more and b <= 317 and e >= 317 + 450 - 97
    assert (codes[b:e] == codes[b + 97 : e + 97]).all() and codes[b - 1] != codes[b + 96]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_run_report_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " \n".join(WORD.findall(periodic_text(rng))) if i % 3 else " ".join(f"v{rng.randint(0, 400)}" for _ in range(rng.randint(1, 300)))) for i in range(120)]
    docs = spark.createDataFrame(rows + [(500, None)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in periodic.run_report(periodic.periodic_runs(periodic.plant_periods(docs))).collect()}
    assert len(got) == 121 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(120)) > 5
    for i, text in [*rows, (500, None)]:
        words = planted(i, WORD.findall(text or ""))
        runs, r = brute_runs(words), got[i]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)) and r["n_runs"] == len(runs)
        assert r["collapsed_sha256"] == sha(brute_collapse(words, runs))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])


def test_runs_of_hard_rows(spark):
    got = periodic.periodic_runs(hard_table(spark)).collect()
    assert len(got) == len(HARD)
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert by[1, 0]["runs"] == [] and by[1, 0]["collapsed"] == "" and by[3, 0]["collapsed"] == ""
    assert [tuple(r) for r in by[7, 40_000]["runs"]] == [(0, 40_000, 1)] and by[7, 40_000]["collapsed"] == "x"
    assert by[None, 30]["collapsed"] == "same words here" and [tuple(r) for r in by[4, 8]["runs"]] == [(0, 8, 2)]
    assert [tuple(r) for r in by[10, 6]["runs"]] == [(0, 6, 1)]
    assert periodic.run_report(periodic.periodic_runs(hard_table(spark).limit(0))).count() == 0


# ---- SimHash


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(fps, ids, bits=2):
    owner = list(range(len(fps)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            owner[root(i)] = root(j)
    least = {}
    for i, n in enumerate(ids):
        if n is not None:
            least[root(i)] = min(n, least.get(root(i), n))
    return [least.get(root(i)) for i in range(len(fps))]


def test_codes_cover_within_their_radius():
    rng = np.random.default_rng(1)
    assert [c.radius for c in simhash.CODES] == [3, 3, 1, 1] and sum(c.length for c in simhash.CODES) == 64
    for code in simhash.CODES:
        words = rng.integers(0, 1 << code.length, 2000).astype(np.uint64)
        home = code.home(words)
        assert (np.bitwise_count(words ^ home) <= code.radius).all() and (code.home(home) == home).all()


def test_close_pairs_share_an_anchor():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    near = simhash.flips(1)
    mine = [set(r.tolist()) for r in simhash.homes(x[:, None] ^ near)]
    assert np.mean([len(m) for m in mine]) < 20
    for k in range(300):
        i, j = rng.choice(64, 2, replace=False)
        y = x[k] ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j))
        assert mine[k] & set(simhash.homes(y ^ near).tolist())


def test_fingerprints_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    import pyarrow as pa

    rng = random.Random(4)
    texts = [None, "", " ", "A", "a b", "É a B c d", *(" ".join(rng.choice(["One", "two", "three", "ß", "x\ny"]) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    assert simhash.fingerprints_of(pa.array(texts, pa.string())).tolist() == [brute_fingerprint(t) for t in texts]
    native = spark.createDataFrame([("one two ß",)], "s string").select(F.xxhash64("s")).first()[0] & (1 << 64) - 1
    assert native == xxhash.xxh64_intdigest("one two ß".encode(), 42)


@pytest.mark.parametrize("crowded", [256, 2])
def test_links_of_clusters_equal_brute_force(spark, crowded):
    """Dense balls of fingerprints, compared in anchors and, where those are crowded, point by point."""
    rng = random.Random(6)
    fps = [0, (1 << 64) - 1]
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            v = centre
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.choice([1, 5, 9, 30, 31, 44, 50, 63])
            fps.append(v)
    fps = sorted({*fps, *(rng.getrandbits(64) for _ in range(50))})
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, crowded)
    got = [(r["a"], r["b"]) for r in links.collect()]
    assert all(a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in got)
    label = dict(zip(signed, range(len(signed))))
    owner = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a, b in got:
            low = min(owner[label[a]], owner[label[b]])
            changed |= owner[label[a]] != low or owner[label[b]] != low
            owner[label[a]] = owner[label[b]] = low
    want = brute_components(fps, list(range(len(fps))))
    groups = lambda x: {frozenset(i for i, v in enumerate(x) if v == o) for o in set(x)}
    assert groups(owner) == groups(want)


def test_components_equal_brute_force(spark):
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    for _ in range(60):  # near copies, some of copies
        words = rng.choice(texts).split()
        if words:
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words).upper() if rng.random() < 0.5 else " ".join(words))
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    rows = [*zip(ids, texts), *HARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=repr)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components(fps, [i for i, _ in rows]))]
    assert got == sorted(want, key=repr) and len({c for _, _, c in want}) < len(want) - 10


def test_components_of_hard_rows(spark):
    got = simhash.simhash_components(hard_table(spark)).collect()
    assert len(got) == len(HARD) and {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 11)} == {6}
    assert simhash.simhash_components(hard_table(spark).limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "one two three four")] * 2, "doc_id long, text string")
    assert [r["component_id"] for r in simhash.simhash_components(alone).collect()] == [None, None]
    with pytest.raises(ValueError):
        simhash.simhash_components(alone, bits=3)


# ---- hard negatives


def brute_negatives(rows, every=50, positives=5, negatives=3, low=50, high=95):
    out = []
    for a, la, xa in rows:
        if a % every:
            continue
        scored = sorted((-int(np.dot(xa, x)), v, label) for v, label, x in rows if v != a)
        for s, v, _ in [r for r in scored if r[2] == la][:positives]:
            fits = [r for r in scored if r[2] != la and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(a, v, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits)]
    return sorted(out)


def vectors(n, dim=12, seed=3, copies=0):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(n, dim)) * 20)
    x[:copies] = x[0] + rng.integers(0, 2, (copies, dim))
    x[copies : copies + 30] = x[n - 1]  # ties
    return [(int(i), int(rng.integers(0, 4)), [float(v) for v in r]) for i, r in enumerate(x)]


@pytest.mark.parametrize("shape", [{}, {"depth": 3, "sample": 100, "chunk": 60}, {"depth": 2, "sample": 3, "chunk": 10_000}])
def test_negatives_equal_brute_force(spark, monkeypatch, shape):
    """With one block and many, cells of many chunks, an upper tree of hardly any sample, a group of near copies and ties."""
    monkeypatch.setattr(negatives, "QUERIES_A_TASK", 7 if shape else 1 << 16)
    rows = vectors(700, copies=230)
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<double>").repartition(3)
    got = sorted(tuple(r) for r in negatives.mine_negatives(df, every=20, **shape).collect())
    assert got == brute_negatives(rows, every=20) and len(got) > 200


def test_blocks_are_pruned():
    """Far fewer rows are scored than there are, with the same result."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (30, 6))
    x = np.repeat(centres, 200, axis=0) + rng.integers(-3, 4, (6000, 6)).astype(float)
    top = float((x * x).sum(axis=1).max())
    chunk = negatives.Chunk(np.arange(6000), np.zeros(6000, np.int64), x, top)
    touched = []

    class Counted(list):
        def __getitem__(self, i):
            touched.append(len(list.__getitem__(self, i)))
            return list.__getitem__(self, i)

    chunk.blocks = Counted(chunk.blocks)
    far = x[(x * x).sum(axis=1).argmax()][None, :]
    minus = np.full(1, -np.inf)
    ids, scores = chunk.search(np.array([-1]), np.zeros(1, np.int64), far, minus, -minus, minus, 3, True)
    s = x @ far[0]
    assert ids[0].tolist() == np.lexsort((np.arange(6000), -s))[:3].tolist() and scores[0].tolist() == sorted(s)[::-1][:3]
    assert sum(touched) < 3000


def test_negatives_of_hard_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, 1, [2.0, 0.0]), (0, 2, [9.0, 9.0]), (1, 1, [1.0]), (2, 2, [1.0, 5.0]), (2, 2, [1.0, 5.0]), (3, 2, [0.9, 0.0]), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [nan, 1.0]), (7, 2, [inf]), (8, 2, [None, 1.0]), (None, 2, [1.0]), (50, 3, [1.0, 1.0]), (9, 2, []), (10, 1, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<double>").withColumns({c: F.lit(1) for c in ("n", "cell", "place", "score", "floor", "kind")})
    got = [tuple(r) for r in negatives.mine_negatives(df).collect()]
    # Anchor 0 is the row of label 1, its best positive scores 2: 1.0 to 1.9 is wanted, 0.9 * 2 = 1.8 fits.
    assert sorted(got) == [(0, 1, 1, 3, 2.0, 1.8)]
    assert negatives.mine_negatives(df.limit(0)).count() == 0
    assert negatives.mine_negatives(df.filter("vec_id = 5")).count() == 0


def test_query_changes_labels_and_components(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 10)) if i % 31 else None, [float(v) for v in rng.normal(size=8) / 2]) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in llm_queries.op13_hard_negatives(spark, str(tmp_path)).collect())
    used = [(i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(x, np.float32).astype(float))) for i, label, x in rows if label is not None]
    assert got == brute_negatives(used) and got
