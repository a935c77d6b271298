"""The pipeline's stages against what their operators say, one after the other."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tallygraph.llm import language_id, lines, pieces
from tallygraph.llm.queries import QUERIES


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    en, fr = "the and of thing erth onion tion sher ander oftion", "le que eau mentre elle oueux éau quier lement deeau"
    text = lambda words, k, n=30: " ".join(words.split()[(k * 7 + i * i + i * k) % 10] + "aeiou"[(i + k) % 5] + str((k * 31 + i * 17) % 7) for i in range(n))
    rows = [(i, text(en if i % 2 else fr, i), "en" if i % 2 else "fr", "s", 1) for i in range(40)]
    rows += [(50, None, None, "s", 0), (51, "123 !!", None, "s", 6), (52, rows[5][1], "en", "s", 1)]
    words = rows[8][1].split()
    words[0] = "changed"
    rows += [(53, " ".join(words), "fr", "s", 1), (54, text(en, 54) + " extra words so that the needle of ten plain words stands here alone truly", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "The needle of ten plain words stands here alone, truly")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(ids(docs))
    assert kept[0] == {r[0] for r in rows} - {50, 51}
    assert kept[1] == kept[0] - {52}  # a full copy loses all its lines
    assert kept[2] == kept[1] - {53}
    assert kept[3] == kept[2] - {54}
    tokens = {r["doc_id"]: r["ids"] for r in docs.collect()}
    v = pieces.load_vocabulary()
    left = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert {i: pieces.decode(t, v) for i, t in tokens.items()} == left
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == kept[4]


def test_native_stages_use_no_python(spark, tmp_path):
    df = spark.createDataFrame([(1, "a line of more than twenty characters\nsecond"), (2, "a line of more than twenty characters")], "doc_id long, text string")
    plan = lines.dedup_report(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert language_id.identify_language(df.withColumn("lang", F.lit("x"))).count() == 2


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_identify_rejects_text_in_no_language(spark):
    rng = random.Random(5)
    parts = {"en": "the and of thing erth onion tion sher ander oftion".split(), "fr": "le que eau mentre elle oueux éau quier lement deeau".split()}
    prose = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, prose(lang, rng.choice([12, 40, 150])), lang) for i in range(60) for lang in [rng.choice(["en", "fr"])]]
    junk = ["x" * 70_000, " ".join("".join(rng.choice("bcdfgjkpvwxz") for _ in range(6)) for _ in range(40)), "Все люди рождаются свободными и равными в своем достоинстве и правах"]
    rows += [(100 + k, t, None) for k, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.identify(spark, docs, "").collect()} == set(range(60))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify(spark, unlabelled, "").count() == len(rows)
