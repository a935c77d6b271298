"""The corpus operators against brute force, on planted cases and on hard tables: nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns with clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallygraph.llm import common, components, decontaminate, divergence, jaccard, language_id, lines, pieces, quality, sharding, substring, toxicity

VOWELS = {"en": "the and of tion ing er", "fr": "le de que eau ment é", "es": "el la que ción os ñ"}


def sentence(rng, lang, n):
    parts = VOWELS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(90):
        lang = rng.choice(list(VOWELS))
        text = "\n".join(sentence(rng, lang, rng.randint(8, 40)).capitalize() + "." for _ in range(rng.randint(1, 4)))
        out.append([i, text, lang, "s", len(text)])
    passage = sentence(rng, "en", 26)
    for i in (11, 23, 47):
        out[i][1] += " " + passage + " " + sentence(rng, "en", 3)
    for i, j in ((50, 5), (51, 5), (52, 6)):
        out[i][1] = out[j][1]
    for i in range(60, 70):  # near copies of one text
        words = out[7][1].split(" ")
        words[rng.randrange(len(words))] = f"x{i}"
        out[i][1] = " ".join(words)
    out[80][1] = "rep " * 60
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty, blank, repeated and very long texts, and columns named as the operators' own."""
    data = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "same words here " * 10), (6, "same words here " * 10), (7, "long text é " * 30_000), (8, "‰§¶ 12!"), (9, "x" * 70_000), (10, "A\nA\n\nA b\r\nz")]
    df = spark.createDataFrame([(i, t, None) for i, t in data], "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("z") for c in ("h", "n", "sig", "k1", "label", "size", "held_out", "removed", "part", "spans", "words", "pos", "count", "score", "target")})


def collect(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- language ID


def test_language_is_found_on_held_out_documents(docs, rows):
    got = collect(language_id.identify_language(docs))
    truth = {r[0]: r[2] for r in rows}
    held = [i for i in got if got[i]["held_out"]]
    assert sorted(held) == [i for i in range(90) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held if i != 80]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_out_of_place_distance_by_hand():
    texts = pa.array(["abab cab", "zzz"])
    row, code, n, alphabet = language_id._grams(texts)
    gram = np.array(language_id._spell(code, alphabet), object)
    want = collections.Counter()
    body = "abab cab"
    for k in range(1, 5):
        for i in range(len(body) - k + 1):
            g = body[i : i + k]
            if g != " ":
                want[g] += 1
    assert dict(zip(gram[row == 0].tolist(), n[row == 0].tolist())) == dict(want)
    order = sorted(want, key=lambda g: (-want[g], len(g), g))
    model = language_id.Classifier({"a": order[:5], "b": order[5:10]}, size=5)
    ranks = {g: i for i, g in enumerate(order[:5])}
    assert model.distances(texts)[0].tolist() == [sum(abs(ranks[g] - i) for i, g in enumerate(order[:5])) / 25, 1.0]


def brute_language(texts, profiles, size):
    """Language and distances by plain dictionaries."""
    import unicodedata

    out = []
    for t in texts:
        body, last = [], None
        for c in (t or "").lower():
            c = c if unicodedata.category(c)[0] in "LM" else " "
            if c != " " or last != " ":
                body.append(c)
            last = c
        body = "".join(body)
        grams = collections.Counter(body[i : i + n] for n in range(1, 5) for i in range(len(body) - n + 1))
        del grams[" "]
        order = sorted(grams, key=lambda g: (-grams[g], len(g), g))[:size]
        far = {}
        for lang, p in sorted(profiles.items()):
            rank = {g: k for k, g in enumerate(p)}
            far[lang] = sum(abs(rank[g] - k) if g in rank else size for k, g in enumerate(order)) / (size * len(order)) if order else 1.0
        letters = any(unicodedata.category(c)[0] == "L" for c in t or "")
        out.append((min(far, key=lambda x: (far[x], x)) if letters else "und", list(far.values())))
    return out


def test_language_equals_brute_force(docs, rows):
    model = language_id.train_classifier(docs)
    profiles = language_id.learn_profiles(docs.filter("lang is not null"), 60)
    texts = [r[1] for r in rows] + [None, "", "½ ² Ⅷ", "Ünï-cödé ÇA\nça", "漢字 かな 漢字", "नमस्ते दुनिया", "ab" * 3000, "12 34"]
    for m, size in ((model, 400), (language_id.Classifier(profiles, 60), 60)):
        named = profiles if size == 60 else language_id.learn_profiles(docs.filter(F.col("lang").isNotNull() & (common.fold("doc_id", 4) != 2)))
        want = brute_language(texts, named, size)
        far = m.distances(pa.array(texts, pa.string()))
        assert far == pytest.approx(np.array([d for _, d in want]))
        assert m.predict(pa.array(texts, pa.string()))[0] == [x for x, _ in want]
    body = "The\nthe"
    row, code, n, alphabet = language_id._grams(pa.array([body]))
    assert dict(zip(language_id._spell(code, alphabet), n.tolist()))["the"] == 2


def test_language_of_hard_rows(spark, hard, docs):
    model = language_id.train_classifier(docs)
    got = language_id.identify_language(hard, model).collect()
    assert len(got) == hard.count()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[1] == by[2] == by[3] == by[8] == "und" and by[7] != "und"
    assert language_id.identify_language(hard).filter("lang_pred <> 'und'").count() == 0  # nothing to learn from
    assert language_id.identify_language(hard.limit(0)).count() == 0
    kept = language_id.keep_identified(hard, classifier=model)
    assert kept.columns == hard.columns and {r["doc_id"] for r in kept.collect()} == {4, None, 6, 7, 9, 10}


# ---- decontamination


def brute_hits(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in texts:
        w, hit, found = low(t), set(), set()
        for item, text in items:
            v = low(text)
            k = min(window, len(v))
            for s in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def test_decontamination_equals_brute_force(spark, docs, rows):
    items = [(100, " ".join(rows[11][1].split()[-20:-4]).upper()), (20, "rep " * 11), (3, "the"), (4, ""), (None, "of"), (100, " ".join(rows[11][1].split()[-20:-4]).upper()), (5, "nowhere to be found é"), (6, rows[30][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == brute_hits([(r[0], r[1]) for r in rows], [x for x in items if x[0] is not None])
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    clean = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert clean == {i for i, v in got.items() if v[1] == 0}


def test_decontamination_of_hard_rows(spark, hard):
    bench = spark.createDataFrame([(1, "same words here same words here same words"), (2, None), (3, "A")], "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(hard, bench).collect()]
    assert len(got) == hard.count() and (1, 0, 0, 0) in got and got.count((4, 1, 1, 1)) == 2 and (6, 30, 29, 1) in got and (None, 30, 29, 1) in got
    assert decontaminate.decontaminate(hard.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(hard, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_keeps_texts_of_one_id_apart(spark):
    words = [f"w{k}" for k in range(10)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    odd = " ".join(w if k % 2 else "x" for k, w in enumerate(words))
    even = " ".join("x" if k % 2 else w for k, w in enumerate(words))
    df = spark.createDataFrame([(7, odd, 1), (7, even, 2), (7, " ".join(words) + " end", 3), (None, " ".join(words), 4)], "doc_id long, text string, text_id int")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in decontaminate.decontaminate(df, bench).collect())
    assert got == [("7", 10, 0), ("7", 10, 0), ("7", 11, 10), ("None", 10, 10)]
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and {r["text_id"] for r in left.collect()} == {1, 2}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a x x x x x b"), (4, "a")], "doc_id long, text string")
    queries = spark.createDataFrame([("q", ["a", "b"]), ("r", ["a", "nope"]), ("s", ["x"])], "query_id string, words array<string>")
    terms = decontaminate.index_terms(queries)
    index = decontaminate.build_index(docs, terms)
    got = {(r["query_id"], r["doc_id"]) for r in decontaminate.proximity_matches(index, queries, terms, 3).collect()}
    assert got == {("q", 1), ("q", 2), ("s", 1), ("s", 3)}


def test_contaminated_rows_without_id_go(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    df = spark.createDataFrame([(None, passage), (None, passage), (2, passage), (None, "clean text"), (3, "clean text"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.decontaminate(df, bench).collect()), key=repr)
    assert got == sorted([(None, 20, 20, True), (None, 20, 20, True), (2, 20, 20, True), (None, 2, 0, False), (3, 2, 0, False), (None, 0, 0, False)], key=repr)
    left = sorted(((r["doc_id"], r["text"]) for r in decontaminate.drop_contaminated(df, bench).collect()), key=repr)
    assert left == sorted([(None, "clean text"), (3, "clean text"), (None, None)], key=repr)


# ---- substring dedup


def brute_repeats(texts, n=20):
    seen, out = set(), {}
    for i, t in sorted(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if k in seen:
                gone[s : s + n] = [True] * n
            seen.add(k)
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeats_equal_brute_force(docs, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs).collect()}
    assert got == brute_repeats([(r[0], r[1]) for r in rows])
    assert got[23][1] >= 26 and got[50][1] == got[50][0]


def test_repeats_of_hard_rows(hard):
    got = substring.remove_repeats(hard).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == hard.count() and by[1]["n_words"] == by[2]["n_words"] == 0
    assert by[6]["n_removed"] == 27 and by[None]["n_removed"] == 30  # a null id counts as the largest
    assert by[7]["n_removed"] == 90_000 - 3
    assert substring.remove_repeats(hard.limit(0)).count() == 0


# ---- quality, toxicity


def test_repeats_of_several_rows_without_id(spark):
    word = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    shared = word("s", 30)
    texts = [(1, word("a", 40) + shared), (None, word("b", 60) + shared + word("c", 5)), (None, word("d", 25)), (None, word("e", 200)), (2, word("f", 50)), (7, word("g", 70) + shared), (7, word("h", 21)), (9, word("i", 90)), (None, word("j", 22)), (None, word("j", 22)), ((1 << 63) - 1, word("k", 20))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string").coalesce(1)
    got = sorted((str(r["doc_id"]), r["kept"]) for r in substring.remove_repeats(df).collect())
    want = sorted((str(i), " ".join(w for w in t if not (w in shared and i != 1))) for i, t in texts)
    twin = (str(None), " ".join(word("j", 22)))
    want[want.index(twin)] = (str(None), "")  # of two equal rows one stays
    assert got == sorted(want)


def test_quality_network_learns_and_scores_every_row(spark, hard):
    rng = random.Random(2)
    good = [(i, sentence(rng, "en", 60), 1) for i in range(160)]
    bad = [(i, sentence(rng, "en", 60).upper().replace(" ", "!! "), 0) for i in range(160, 320)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, y int")
    labels = df.select("doc_id", F.col("y").alias("quality")).unionAll(df.limit(3).select("doc_id", F.lit(None).cast("int")))
    net = quality.train_network(df, labels, max_train_docs=200)
    got = collect(quality.score_quality(df.drop("y"), network=net).join(df.select("doc_id", "y"), "doc_id"))
    held = [r for r in got.values() if r["held_out"]]
    assert np.mean([r["predicted"] == r["y"] for r in held]) > 0.95
    some = quality.score_quality(hard, network=net).collect()
    assert len(some) == hard.count() and all(0 <= r["score"] <= 1 for r in some)
    assert len({r["score"] for r in some if r["doc_id"] in (1, 2)}) == 1
    assert quality.score_quality(hard.limit(0), network=net).count() == 0


def test_quality_network_covers_the_end_of_long_texts():
    net = quality.ByteConvNet()
    data = np.frombuffer(b"plain words " * 3000, np.uint8)
    a = quality._blocks(data, np.array([0, len(data)]))
    assert len(a[0]) * quality.STEP >= len(data) and (a[0].ravel()[: len(data)] == data).all()
    two = np.frombuffer(b"abcdefgh" * 5 + b"xyz", np.uint8)
    both = net.scores(two, np.array([0, 40, 43]))
    assert both == pytest.approx([net.scores(two[:40], np.array([0, 40]))[0], net.scores(two[40:], np.array([0, 3]))[0]])


def plain_network_score(net, text):
    """Every chunk of two blocks of eight bytes by itself, one number after the other."""
    data = list(text)
    again = [float(any(i - lag >= 7 and data[i - 7 : i + 1] == data[i - lag - 7 : i - lag + 1] for lag in range(2, 25))) for i in range(len(data))]
    codes = data + [256] * (max(8, -(-len(data) // 8) * 8) - len(data))
    again += [0.0] * (len(codes) - len(again))
    blocks = [np.array([[*net.emb[c], a] for c, a in zip(codes[b : b + 8], again[b : b + 8])]).reshape(-1) for b in range(0, len(codes), 8)]
    best = np.full(quality.FILTERS, -np.inf)
    for b, x in enumerate(blocks):
        r = x @ net.conv[0] + (blocks[b + 1] @ net.conv[1] if b + 1 < len(blocks) else 0)
        best = np.maximum(best, r)
    z = np.maximum(best + net.bias, 0) @ net.out + net.out_bias[0]
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize("piece", [quality.PIECE, 64])
def test_network_equals_a_plain_loop(monkeypatch, piece):
    """Over texts of no to some thousand bytes, some of which repeat themselves, in one piece and in many."""
    monkeypatch.setattr(quality, "PIECE", piece)
    rng, net = random.Random(11), quality.ByteConvNet(seed=8)
    net.bias += np.linspace(-0.3, 0.3, quality.FILTERS).astype(np.float32)
    texts = [b"", b"a", b"ab" * 40, b"x" * 7, "é ‰".encode() * 9] + [bytes(rng.choices(range(97, 103), k=rng.randint(1, 300))) for _ in range(40)] + [(b"some words are said " * 30)[: rng.randint(1, 500)] for _ in range(10)]
    off = np.cumsum([0, *map(len, texts)])
    got = net.scores(np.frombuffer(b"".join(texts), np.uint8), off)
    assert got == pytest.approx([plain_network_score(net, t) for t in texts], abs=1e-5)


def test_votes_equal_a_plain_loop():
    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 12))) for _ in range(150)]
    y, rate = rng.integers(0, 2, 150).astype(float), rng.choice([0.25, 1.0], 150)
    h = toxicity._terms(pa.array([" ".join(vocab)]))[1]
    index = toxicity.ExampleIndex([(int(t), 1.0 + i % 5) for i, t in enumerate(sorted(set(h.tolist())))], np.arange(150), pa.array(texts), y, rate)
    asked = texts[:20] + ["", "nothing known", None]
    scores, evidence, cosines = index.score(pa.array(asked, pa.string()), 7)
    row, term, value = index.vectors(pa.array([t or "" for t in texts + asked]))
    dense = np.zeros((len(texts) + len(asked), index.n_terms))
    dense[row, term] = value
    base, weight = sum(y / rate) / sum(1 / rate), 1 / rate
    place = {int(d): k for k, d in enumerate(index.doc_ids)}
    for k in range(len(asked)):
        cos = dense[:150] @ dense[150 + k]
        near = sorted(range(150), key=lambda i: (-round(cos[i], 12), place[i]))[:7]
        vote = [cos[i] * weight[i] / weight.mean() for i in near]
        want = (sum(v * y[i] for v, i in zip(vote, near)) + toxicity.PRIOR_VOTE * base) / (sum(vote) + toxicity.PRIOR_VOTE)
        assert scores[k] == pytest.approx(want) and cosines[k] == pytest.approx([cos[i] for i in near[:3]])


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 15))) for _ in range(400)]
    h = toxicity._terms(pa.array([" ".join(vocab)]))[1]
    index = toxicity.ExampleIndex([(int(t), 1.0 + i % 7) for i, t in enumerate(sorted(set(h.tolist())))], np.arange(400), pa.array(texts), rng.integers(0, 2, 400).astype(float), np.ones(400))
    dense = np.zeros((400, index.n_terms))
    r, t, v = index.vectors(pa.array(texts))
    place = {int(d): k for k, d in enumerate(index.doc_ids)}
    dense[[place[int(x)] for x in r], t] = v
    for q in range(0, 400, 7):
        mine = r == q
        at, cos = index.nearest(t[mine], v[mine], 15)
        want = np.sort(dense @ dense[place[q]])[::-1][:15]
        assert cos == pytest.approx(want) and len(set(at.tolist())) == 15


def test_toxicity_is_caught_and_hard_rows_are_scored(spark, hard):
    rng = random.Random(3)
    rows = [(i, sentence(rng, "en", 50) + (" vile nasty vile " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.build_index(df, df.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(df.drop("toxic"), index=index).join(df.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r["predicted"] == r["toxic"] for r in got if r["held_out"])
    assert all(len(r["evidence"]) == 3 for r in got)
    some = toxicity.score_toxicity(hard, index=index).collect()
    assert len(some) == hard.count() and all(r["predicted"] == 0 for r in some)
    assert toxicity.score_toxicity(hard, hard.select("doc_id", F.lit(None).cast("int").alias("toxic"))).filter("score > 0").count() == 0
    assert toxicity.score_toxicity(hard.limit(0), index=index).count() == 0


# ---- sharding


def test_matrix_has_exact_margins_and_is_uniform():
    rows, sizes = [7, 0, 13, 5], [9, 8, 8]
    m = sharding.communication_matrix(rows, sizes, (1,))
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == sizes
    mean = np.mean([sharding.communication_matrix(rows, sizes, (s,)) for s in range(2000)], axis=0)
    assert mean == pytest.approx(np.outer(rows, sizes) / 25, abs=0.15)


@pytest.mark.parametrize("per_block", [1_000_000, 2])
def test_shards_are_exact(docs, rows, per_block):
    got = sharding.shard_documents(docs, shards=7, rows_per_block=per_block).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(map(len, by.values())) == sorted([13] * 6 + [12]) and all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {r[0]: r[1].encode() for r in rows}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 8, zlib.crc32(text[r["doc_id"]])) for r in got)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs, shards=7, rows_per_block=per_block).collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in got}


def test_shards_of_hard_rows(hard):
    got = sharding.shard_documents(hard, shards=4).collect()
    assert sorted(collections.Counter(r["shard"] for r in got).values()) == [2, 3, 3, 3]
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (1, 2)} == {(8, 0)}
    assert sharding.shard_documents(hard.limit(0)).count() == 0


# ---- line dedup


def edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edit_automaton(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 10)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.edit_within(F.col("a"), F.col("b"), threshold).alias("w")).collect()
    assert all(r["w"] == (edit(r["a"], r["b"]) <= threshold) for r in got)


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    base = [sentence(rng, "fr", rng.randint(4, 9)) for _ in range(25)]
    rows = []
    for i in range(40):
        picked = [list(rng.choice(base)) for _ in range(rng.randint(1, 4))]
        for x in picked:
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randint(0, len(x))
                x[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "ü"])
        rows.append((i, "\n".join(map("".join, picked)) + rng.choice(["", "\n", "\n\nshort"])))
    first, occ = {}, []
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            if x.strip():
                occ.append((i, k, x))
                first.setdefault(x, (i, k))
    near = {max(a, b, key=first.get) for a in first for b in first if a < b and min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2}
    want = collections.defaultdict(list)
    for i, k, x in occ:
        if first[x] != (i, k) or x in near:
            want[i].append(k)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.dedup_report(df).collect()}
    assert near and {i: r["removed"] for i, r in got.items() if r["removed"]} == {i: v for i, v in want.items() if v}
    texts = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert texts == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows}


def brute_lines(rows, bands):
    first, occ = {}, []
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            if x.strip():
                occ.append((i, k, x))
                first.setdefault(x, (i, k))
    allowed = lambda a, b: max([e for least, e in bands if min(len(a), len(b)) >= least], default=0)
    near = {max(a, b, key=first.get) for a in first for b in first if a < b and abs(len(a) - len(b)) <= allowed(a, b) and edit(a, b) <= allowed(a, b)}
    want = collections.defaultdict(list)
    for i, k, x in occ:
        if first[x] != (i, k) or x in near:
            want[i].append(k)
    return dict(want)


@pytest.mark.parametrize("hot", [256, 1])
def test_lines_in_bands_equal_brute_force(spark, monkeypatch, hot):
    """Lines of 8 to 150 characters around the limits of the bands, with hot segments (all of them where hot is 1)."""
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(31)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)).replace("\n", "").strip() + "z" for n in (8, 11, 12, 13, 22, 24, 25, 40, 63, 64, 72, 94, 96, 97, 120, 128, 150)]
    rows = []
    for i in range(45):
        picked = [list(rng.choice(base)) for _ in range(2)]
        for x in picked:
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                k = rng.randint(0, len(x))
                x[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "ü"])
        rows.append((i, "\n".join(map("".join, picked))))
    got = {r["doc_id"]: r["removed"] for r in lines.dedup_report(spark.createDataFrame(rows, "doc_id long, text string"), bands=lines.BANDS).collect()}
    want = brute_lines(rows, lines.BANDS)
    assert len(want) > 20 and {i: r for i, r in got.items() if r} == want


def test_lines_that_share_a_tail_meet_only_their_like(spark, monkeypatch):
    rng = random.Random(1)
    digits = list("000111222333444555666777")
    rows = []
    for i in range(900):
        rng.shuffle(digits)
        rows.append((i, "".join(digits) + " and this is one shared tail of quite a few words that every line ends with here"))
    rows.append((900, rows[7][1].replace("7", "x", 1)))
    seen = []
    sifted, verified = lines._sifted, lines._verified
    monkeypatch.setattr(lines, "_sifted", lambda met, texts: seen.append(met.count()) or sifted(met, texts))
    monkeypatch.setattr(lines, "_verified", lambda met, texts, most: seen.append(met.count()) or verified(met, texts, most))
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_report(spark.createDataFrame(rows, "doc_id long, text string"), bands=lines.BANDS).collect()}
    assert {i for i, n in got.items() if n} == {900}
    assert sum(seen) < 20 * len(rows)


def test_lines_of_rows_without_id_and_of_one_id_stay_apart(spark):
    texts = [(1, "alpha line that is here first"), (None, "beta beta line of its own\nalpha line that is here first"), (None, "gamma gamma line of its own\na wholly unique second line"), (5, "delta delta line\nepsilon epsilon"), (5, "zeta zeta zeta\nalpha line that is here first"), (None, "beta beta line of its own\nalpha line that is here first")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("row_key", "removed", "row", "at", "gone_id")})
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = [(1, texts[0][1]), (None, "beta beta line of its own"), (None, texts[2][1]), (5, texts[3][1]), (5, "zeta zeta zeta"), (None, "")]
    assert got == collections.Counter(want)
    assert out.count() == 6 and lines.dedup_lines(df, keep_emptied=False).count() == 5


def test_lines_of_hard_rows(hard):
    rows = lines.dedup_report(hard).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == hard.count() and by[1]["n_lines"] == 0 and by[2]["n_lines"] == 1
    assert by[10]["removed"] == [1] and by[None]["removed"] == [0] and by[6]["removed"] == []
    out = lines.dedup_lines(hard)
    assert out.columns == hard.columns
    t = {r["doc_id"]: r["text"] for r in out.collect()}
    assert t[1] is None and t[3] == " \n\t " and t[10] == "A\n\nA b\r\nz" and t[None] == ""
    assert lines.dedup_lines(hard.limit(0)).count() == 0


# ---- n-gram Jaccard join


def brute_components(texts, width, num, den):
    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    ids, ss = [i for i, _ in texts], [sets(t) for _, t in texts]
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            k = len(ss[a] & ss[b])
            if k and den * k >= num * (len(ss[a]) + len(ss[b]) - k):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (len(ss[k]), least[find(k)]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_components_equal_brute_force(docs, rows, width, num, monkeypatch):
    want = brute_components([(r[0], r[1]) for r in rows], width, num, 100)
    for short in (2, 32):  # with and without central members of long lists
        monkeypatch.setattr(jaccard, "SHORT_LIST", short)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, width, num, 100).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) < 90
    kept = jaccard.keep_one_of_each(docs, width, num, 100)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}


def test_components_of_hard_rows(hard):
    got = [tuple(r) for r in jaccard.jaccard_components(hard).collect()]
    assert len(got) == hard.count() and (1, 0, 1) in got and (3, 0, 3) in got and got.count((4, 1, 4)) == 2 and (None, 3, 6) in got
    assert jaccard.jaccard_components(hard.limit(0)).count() == 0
    left = [(r["doc_id"], r["text"]) for r in jaccard.keep_one_of_each(hard).collect()]
    # One of the rows (4, "a"), and not the row without id whose text row 6 has.
    assert len(left) == hard.count() - 2 and left.count((4, "a")) == 1 and not any(i is None for i, _ in left)


def test_components_reach_through_rows_without_id(spark):
    words = [f"w{k}" for k in range(60)]
    text = lambda *changed: " ".join("x" + w if k in changed else w for k, w in enumerate(words))
    rows = [(1, text()), (None, text(59)), (3, text(0, 59)), (None, "alone " * 9), (None, "alone " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("gone_id", "row", "component_id")})
    num, den = 96, 100  # each within one changed word of the next, the ends are not within two
    want = [(1, 1), (None, 1), (3, 1), (None, None), (None, None)]
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(df, 3, num, den).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = jaccard.keep_one_of_each(df, 3, num, den)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]


def test_long_lists_of_unlike_texts_give_few_pairs(spark, monkeypatch):
    """Texts of one template, each with some words that few others have: their common shingles make no pairs to verify."""
    seen = []
    real = jaccard._Threshold.verify
    monkeypatch.setattr(jaccard._Threshold, "verify", lambda self, pairs, lists: seen.append(pairs.count()) or real(self, pairs, lists))
    base, rows = [f"t{k}" for k in range(95)], []
    for i in range(300):
        words = list(base)
        words[40:46] = [f"g{i // 3}x{k}" if k < 4 else f"o{i}x{k}" for k in range(6)]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 300, 50)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    want = {i: c for i, (_, c) in brute_components(rows, 3, 90, 100).items()}
    assert got == want and len(set(want.values())) < 300 and sum(seen) < 3000


def test_one_of_each_is_a_row_not_an_id(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, base, "a"), (5, base + " ", "b"), (5, "something wholly different that no other row has", "c"), (None, "same text twice without any id", "d"), (None, "same text twice without any id", "e"), (7, "this row is there twice", "f"), (7, "this row is there twice", "g"), (8, None, "h"), (8, "", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string").repartition(3)
    kept = jaccard.keep_one_of_each(df)
    marks = sorted(r["row_key"] for r in kept.collect())
    assert kept.columns == df.columns and len(marks) == 6
    assert {"a", "c", "h", "i"} <= set(marks) and len({"d", "e"} & set(marks)) == 1 and len({"f", "g"} & set(marks)) == 1


def test_connected_components(spark):
    rng = random.Random(0)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    links = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long")
    got = {r["v"]: r["label"] for r in components.components(links).collect()}
    root = {v: v for p in pairs for v in p}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in got}
    assert components.components(links.limit(0)).count() == 0


# ---- quality rules


def test_base_rules_equal_brute_force(docs, rows):
    got = collect(divergence.judge(docs))
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {p for s in range(len(w) - 2) if tri[w[s], w[s + 1], w[s + 2]] > 1 for p in (s, s + 1, s + 2)}
        seen, dup = set(), 0
        for x in text.split("\n"):
            if x.strip():
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w))


def test_divergence_tells_junk_from_prose(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, "es", 150), "es") for i in range(40)] + [(99, "#$ 12 | " * 100 + " ".join(str(k * 7919) for k in range(300)), "es"), (98, sentence(rng, "es", 100), None)]
    got = collect(divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i]["kept"] for i in [*range(40), 98]) and not got[99]["kept"] and not got[99]["base_failed"]


def test_limits_learned_from_labels_drop_junk_near_prose(spark):
    rng = random.Random(2)
    junk = lambda: " ".join(x if rng.random() < 0.5 else "".join(rng.choice("aeioslnr") for _ in range(7)) for x in sentence(rng, "es", 200).split())
    rows = [(i, sentence(rng, "es", 200), "es") for i in range(160)] + [(i, junk(), "es") for i in range(200, 212)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    labels = spark.createDataFrame([(i, int(i < 200) if not held(i) else None) for i, _, _ in rows], "doc_id long, quality int")
    loose, got = collect(divergence.judge(df)), collect(divergence.judge(df, labels=labels))
    assert all(loose[i]["kept"] for i in range(200, 212))  # the fixed limits let it pass
    assert not any(got[i]["kept"] for i in range(200, 212)) and sum(got[i]["kept"] for i in range(160)) >= 156
    assert any(held(i) for i in range(200, 212))
    few = labels.filter("doc_id < 20")
    assert {i: r["kept"] for i, r in collect(divergence.judge(df, labels=few)).items()} == {i: r["kept"] for i, r in loose.items()}


def test_jensen_shannon():
    p, q = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]]), np.array([0.0, 0.0, 1.0])
    assert divergence.js_distance(p, q) == pytest.approx([1.0, 1.0])
    assert divergence.js_distance(p, np.array([0.5, 0.5, 0.0]))[0] == 0


def test_rules_of_hard_rows(hard):
    got = divergence.judge(hard).collect()
    assert len(got) == hard.count() and all(r["base_failed"] for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert {r["n_dup_lines"] for r in got if r["doc_id"] == 10} == {1}
    assert divergence.judge(hard.limit(0)).count() == 0


def plain_distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    part = lambda x: sum(a * np.log2(a / c) for a, c in zip(x, m) if a > 0)
    return np.sqrt(min(1.0, max(0.0, (part(p) + part(q)) / 2)))


def test_limits_come_from_every_clean_document(spark):
    """20,000 labelled documents, more than any sample held before: the quantile of all of them, by rank."""
    n = 20_000
    draw = lambda k: (F.col("doc_id") * k % 10_007) / 20_014.0
    measured = spark.range(n).select(F.col("id").alias("doc_id")).select("doc_id", (F.col("doc_id") % 11 == 0).alias("base_failed"), F.lit(True).alias("class_long"), (F.col("doc_id") % 3 > 0).alias("word_long"), draw(7919).alias("class_distance"), draw(104_729).alias("word_distance"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 5 > 0).cast("int").alias("quality"))
    got = divergence.learn_limits(measured, labels)
    clean = [i for i in range(n) if i % 5 and i % 11 and zlib.crc32(str(i).encode()) % 4 != 2]
    want = [np.quantile([i * k % 10_007 / 20_014 for i in ids], divergence.CLEAN_QUANTILE) * divergence.MARGIN for k, ids in ((7919, clean), (104_729, [i for i in clean if i % 3]))]
    assert (got.max_class_distance, got.max_word_distance) == pytest.approx(tuple(want))


def test_verdicts_equal_a_plain_loop(spark):
    """References counted over all texts, both distances and the verdict, one text after the other."""
    rng = random.Random(21)
    rows = [(i, sentence(rng, lang, rng.randint(20, 90)), lang) for i, lang in enumerate(["en", "fr", "es"] * 12)]
    rows += [(100 + i, " ".join("".join(rng.choices("#$%&01289", k=6)) for _ in range(70)), None) for i in range(3)]
    rows += [(200, "the " * 60, "en"), (201, None, "en"), (202, "", "fr"), (203, sentence(rng, "en", 8), None)]
    limits = divergence.Limits(common_words=12, max_class_distance=0.2, max_word_distance=0.45)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    references = divergence.learn_references(df, limits)
    got = collect(divergence.judge(df, limits))
    classes = {i: divergence.Text(pa.array([t or ""])).class_counts()[0] for i, t, _ in rows}
    words = {i: (t or "").lower().split() for i, t, _ in rows}
    key = {w: int(common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])).view(np.int64)[0]) for ws in words.values() for w in ws}
    ref = {}
    for lang in ("en", "fr", "es"):
        mine = [i for i, t, x in rows if x == lang and t is not None]
        shape, n = sum(classes[i] for i in mine), collections.Counter(w for i in mine for w in words[i])
        common_words = sorted(n, key=lambda w: (-n[w], key[w]))[:12]
        ref[lang] = (shape / shape.sum(), {w: n[w] / sum(n.values()) for w in common_words})
        assert references[lang][0] == pytest.approx(ref[lang][0].tolist()) and references[lang][1] == pytest.approx({key[w]: v for w, v in ref[lang][1].items()})
    seen = set()
    for i, t, _ in rows:
        total, ws, near, best = classes[i].sum(), words[i], False, (1.0, 1.0)
        for lang in sorted(ref):
            shape, common_words = ref[lang]
            dc = plain_distance((classes[i] / max(1, total)).tolist(), shape.tolist())
            hist = [ws.count(w) / max(1, len(ws)) for w in common_words]
            rest = sum(w not in common_words for w in ws) / max(1, len(ws))
            dw = plain_distance([*hist, rest], [*common_words.values(), 1 - sum(common_words.values())])
            near |= (dc <= limits.max_class_distance or total < limits.min_chars) and (dw <= limits.max_word_distance or len(ws) < limits.min_words)
            best = min(best, (dc, dw), key=sum)
        r = got[i]
        assert r["kept"] == (bool(near) and not r["base_failed"])
        assert (r["class_distance"], r["word_distance"]) == pytest.approx(best, abs=1e-9)
        seen.add((r["kept"], r["base_failed"]))
    assert {(True, False), (False, True), (False, False)} <= seen


# ---- pieces


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("sentencepiece")
    return pieces.load_vocabulary()


def all_cuts(unit, v):
    edges = pieces._edges(unit, v)

    def to(e):
        return [0.0] if e == 0 else [a + w for s, _, w in edges[e] for a in to(s)]

    return sorted(to(len(unit)), reverse=True)


def test_n_best_equals_all_cuts(vocabulary):
    for unit in ("▁hello", "▁▁the", "zzq€", "▁aaaa"):
        got = pieces.n_best(unit, vocabulary, 6)
        assert [round(s, 3) for s, _ in got] == [round(s, 3) for s in all_cuts(unit, vocabulary)[:6]]
        assert len({tuple(i) for _, i in got}) == len(got)


def test_texts_n_best_equals_all_cuts(vocabulary):
    for text in ("the cat", "a  b", "x▁y\nq€", "ñandú"):
        sums = [0.0]
        for u in pieces._UNIT.findall(" " + text):
            cuts = [vocabulary.unknown] if u == "▁" else all_cuts(u.replace(" ", "▁"), vocabulary)
            sums = sorted((a + b for a in sums for b in cuts), reverse=True)[:200]
        assert pieces.Encoder(vocabulary, 4).encode([text])[2][0] == pytest.approx(sums[:4])


def test_every_cut_has_its_ids_and_decodes(spark, docs, hard, vocabulary):
    text = "the cat zzq€ ñandú " + "ab" * 30
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").unionByName(hard.filter("doc_id <> 2").select((F.col("doc_id") + 100).alias("doc_id"), "text")).unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    encoded = pieces.encode_documents(rows)
    texts = collect(rows)
    for i, r in collect(encoded).items():
        cuts = r["nbest_ids"]
        assert len(cuts) == len(r["nbest_scores"]) == len(set(map(tuple, cuts))) and cuts[0] == r["ids"]
        for ids, score in zip(cuts, r["nbest_scores"]):
            assert pieces.decode(ids, vocabulary) == (texts[i]["text"] or "")
            if i == 1:  # every cut has the score that stands beside it; a character outside the vocabulary is one step
                known = sum(vocabulary.scores[k] for k in ids if not vocabulary.first_byte <= k < vocabulary.first_byte + 256)
                odd = sum(1 for k in ids if vocabulary.first_byte <= k < vocabulary.first_byte + 256 and (k - vocabulary.first_byte) & 0xC0 != 0x80)
                assert known + odd * vocabulary.unknown == pytest.approx(score)
    back = collect(pieces.decode_documents(encoded))
    assert {i: r["decoded"] for i, r in back.items()} == {i: r["text"] or "" for i, r in texts.items()}
    assert collect(pieces.encode_documents(rows, decoded=True)) == back
    assert {len(r["nbest_sha256"]) - len(r["nbest_scores"]) for r in pieces.encode_and_verify(rows).collect()} == {0}


def test_a_wrong_alternative_cut_is_seen(spark, vocabulary, monkeypatch):
    coder = pieces.Encoder(vocabulary, 3)
    ids, off, _, others = coder.encode(["the cat sat"])
    assert pieces._all_decode([ids, *others[0]], "the cat sat", vocabulary)
    others[0][1] = others[0][1][:-1]
    assert not pieces._all_decode([ids, *others[0]], "the cat sat", vocabulary)


def test_units_that_decode_otherwise_are_seen(vocabulary, monkeypatch):
    """A cut is judged by the units in which it differs from the best one."""
    right = pieces.n_best
    coder = pieces.Encoder(vocabulary, 3)
    coder.encode(["the cat sat", None])
    assert coder.alike == [True, True]
    monkeypatch.setattr(pieces, "n_best", lambda u, v, n: [right(u, v, n)[0], *((loss, ids[:-1]) for loss, ids in right(u, v, n)[1:])])
    coder = pieces.Encoder(vocabulary, 3)
    coder.encode(["the cat sat"])
    assert coder.alike == [False]


def test_round_trip_of_every_text(docs, hard, vocabulary):
    assert pieces.encode_and_verify(docs).filter("not round_trip").count() == 0
    got = pieces.encode_and_verify(hard)
    assert got.filter("not round_trip").count() == 0 and got.count() == hard.count()
    assert {r["n_tokens"] for r in got.filter("doc_id in (1, 2)").collect()} == {0}
    ids = pieces.encode_documents(hard).filter("doc_id = 10").first()["ids"]
    assert pieces.decode(ids, vocabulary) == "A\nA\n\nA b\r\nz"
    assert pieces.encode_documents(hard.limit(0)).count() == 0


def test_many_units_at_once_equal_one_by_one(vocabulary):
    rng = random.Random(4)
    units = ["▁" + "".join(rng.choice("abcdethz é€") for _ in range(8)).replace(" ", "x") for _ in range(200)]
    ids, count, known, best, second = pieces._cut_many(units, vocabulary)
    at = np.cumsum(count) - count
    for k, u in enumerate(units):
        cuts = pieces.n_best(u, vocabulary, 2)
        assert (best[k], second[k]) == pytest.approx((cuts[0][0], cuts[1][0]))
        assert known[k] == bool(ids[at[k] : at[k] + count[k]].all())


# ---- shared helpers


def test_word_hashes_and_windows():
    data, off = common.byte_view(pa.array(["ab cd ab", None, "", "ab", " x "]))
    s, e, row = common.word_spans(data, off, common.NON_SPACE)
    assert row.tolist() == [0, 0, 0, 3, 4]
    h = common.word_hashes(data, s, e)
    assert h[0] == h[2] == h[3] and len(set(h.tolist())) == 3
    assert common.window_hashes(h, 2)[0] != common.window_hashes(h, 2)[1]


def test_slices_are_whole_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 30, None, "b" * 500, "c", ""]})
    parts = list(common.text_slices(iter([batch]), limit=64))
    assert [p.num_rows for p in parts] == [2, 1, 2] and pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
