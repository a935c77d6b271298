"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

The index is a table of token postings (term, doc_id, pos). A phrase is looked up from its rarest terms: their posting
lists, shifted by the term's place in the phrase, must meet at one start. Only starts where the two rarest meet are
compared word by word, again on postings. Windows that share their two rarest terms share that work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, small

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words once A-Z are lower-cased are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+; on the text as it is, these runs.
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def raw_words(text: str | Column) -> Column:
    """Words in the text's own case, in order; null for a null text."""
    return F.regexp_extract_all(text, F.lit(_RAW_WORD), F.lit(0))


#: Stands behind a document's last word in the index, so that its place is the number of words; no word has it.
END = "\n"
END_ID = -1


def index_terms(phrases: DataFrame) -> DataFrame:
    """term, term_id for each distinct word of phrases(words)."""
    terms = phrases.select(F.explode("words").alias("term")).distinct()
    return materialize(terms.withColumn("term_id", F.monotonically_increasing_id()), "terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Token postings term_id, doc_id, pos of documents(doc_id, text) for the given terms(term, term_id), written to the
    shared folder; each text that is not null has one more, of END_ID at the place behind its last word."""
    tokens = docs.select("doc_id", F.posexplode(F.concat(raw_words("text"), F.array(F.lit(END)))).alias("pos", "word")).withColumn("key", F.lower("word"))
    ends = docs.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(END_ID).cast("long").alias("term_id"))
    keyed = small(terms.select("term", "term_id").unionAll(ends).select(F.lower("term").alias("key"), "term", "term_id"))
    # lower() also folds letters beyond ASCII; the term itself decides.
    same = (F.col("word") == F.col("term")) | (_lower_ascii(F.col("word")) == F.col("term"))
    return materialize(tokens.join(keyed, "key").filter(same).select("term_id", "doc_id", "pos"), "postings")


def _phrases(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id (string), item (number of the distinct phrase rows), words, n, w (window length)."""
    words = F.coalesce(F.transform(raw_words("text"), _lower_ascii), F.array().cast("array<string>"))
    items = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words.alias("words")).filter(F.size("words") > 0).distinct()
    items = items.withColumn("n", F.size("words")).withColumn("w", F.least("n", F.lit(window)))
    return materialize(items.withColumn("item", F.monotonically_increasing_id()), "phrases")


def with_text_id(docs: DataFrame, name: str) -> DataFrame:
    """docs(doc_id, text, ...) with a number that names the text in postings: the doc_id where no other row has it, else
    a hash of doc_id and text, so that rows of one id with different texts stay apart. A row without id is named by a
    hash of its text alone: what is found depends on the text only."""
    number = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    nameless = F.xxhash64(F.lit("no id"), text)
    again = docs.filter(number.isNotNull()).groupBy(number.alias(f"{name}_id")).agg(F.count("*").alias(f"{name}_n")).filter(F.col(f"{name}_n") > 1)
    if not again.limit(1).count():
        return docs.withColumn(name, F.coalesce(number, nameless))
    found = docs.join(small(again), number == F.col(f"{name}_id"), "left")
    own = F.when(F.col(f"{name}_n").isNull(), F.coalesce(number, nameless)).otherwise(F.xxhash64(number, text))
    return found.withColumn(name, own).select(*docs.columns, name)


def phrase_index(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases and terms of the benchmark, and the postings of those terms in documents(doc_id, text)."""
    phrases = _phrases(benchmark, window)
    terms = index_terms(phrases)
    return phrases, terms, build_index(docs, terms)


def phrase_matches(phrases: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, item_id, begin, end: word ranges of documents in which every window's words are consecutive words of the item."""
    parts = phrases.select("item", "n", "w", F.posexplode("words").alias("ipos", "term")).join(terms, "term").select("item", "n", "w", "ipos", "term_id")
    counts = index.groupBy("term_id").count()
    parts = materialize(parts.join(counts, "term_id", "left").withColumn("count", F.coalesce("count", F.lit(0))), "phrase-parts")

    # Each window's two rarest terms; a window with a term that no document has is nowhere.
    windows = parts.select("item", "n", "w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - F.col("w") + 1), F.least(F.col("ipos"), F.col("n") - F.col("w")))).alias("start"), "ipos", "term_id", "count")
    rarest = F.sort_array(F.collect_list(F.struct("count", "ipos", "term_id")))
    windows = windows.groupBy("item", "start", "w").agg(rarest.alias("by"), F.min("count").alias("least")).filter("least > 0")
    first, second = F.col("by")[0], F.when(F.col("w") > 1, F.get("by", F.lit(1))).otherwise(F.col("by")[0])
    seeds = windows.select("item", first["term_id"].alias("t1"), first["ipos"].alias("p1"), second["term_id"].alias("t2"), second["ipos"].alias("p2")).distinct()
    seeds = materialize(seeds, "phrase-seeds")

    def starts(term: str, place: str) -> DataFrame:
        some = index.join(small(seeds.select("item", "p1", "p2", F.col(term).alias("term_id"))), "term_id")
        return some.select("doc_id", "item", "p1", "p2", (F.col("pos") - F.col(place)).alias("diag"))

    met = starts("t1", "p1").join(starts("t2", "p2"), ["doc_id", "item", "p1", "p2", "diag"]).select("doc_id", "item", "diag").distinct()
    met = materialize(met, "phrase-starts")

    near = index.join(small(met.select("doc_id").distinct()), "doc_id", "left_semi")
    wanted = met.join(small(parts.select("item", "n", "w", "ipos", "term_id")), "item").withColumn("pos", F.col("diag") + F.col("ipos"))
    hits = wanted.join(near, ["doc_id", "pos", "term_id"]).select("doc_id", "item", "diag", "ipos", "w").distinct()
    run = F.col("ipos") - F.row_number().over(Window.partitionBy("doc_id", "item", "diag").orderBy("ipos"))
    runs = hits.withColumn("run", run).groupBy("doc_id", "item", "diag", "run").agg(F.min("ipos").alias("lo"), F.max("ipos").alias("hi"), F.first("w").alias("w"))
    runs = runs.filter("hi - lo + 1 >= w")
    return runs.join(small(phrases.select("item", "item_id")), "item").select("doc_id", "item_id", (F.col("diag") + F.col("lo")).alias("begin"), (F.col("diag") + F.col("hi")).alias("end"))


def proximity_matches(index: DataFrame, queries: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """query_id, doc_id, pos: places of a query's rarest term with all its other terms at most ``slop`` words away.

    index holds postings (term_id, doc_id, pos) of terms(term, term_id); queries(query_id, words) lists distinct terms.
    A query with a term outside the index is nowhere.
    """
    asked = queries.select("query_id", F.size(F.array_distinct("words")).alias("k"), F.explode(F.array_distinct("words")).alias("term")).join(terms, "term")
    asked = asked.join(index.groupBy("term_id").count(), "term_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("count", "term_id"))
    asked = asked.withColumn("rank", rank)
    anchor = index.join(small(asked.filter("rank = 1").select("query_id", "k", "term_id")), "term_id").select("query_id", "k", "doc_id", F.col("pos").alias("at"))
    other = index.join(small(asked.filter("rank > 1").select("query_id", "term_id")), "term_id")
    close = anchor.join(other, ["query_id", "doc_id"], "left").filter((F.col("k") == 1) | (F.abs(F.col("pos") - F.col("at")) <= slop))
    close = close.groupBy("query_id", "k", "doc_id", "at").agg(F.countDistinct("term_id").alias("met"))
    return close.filter((F.col("met") == F.col("k") - 1) | (F.col("k") == 1)).select("query_id", "doc_id", F.col("at").alias("pos"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of documents(doc_id, text).

    A word is hit if it is in any occurrence of ``window`` consecutive words of an item of benchmark(item_id, text); an
    item of fewer words, but not none, is one window. items_sha256 is that of the items' ids, sorted as strings and
    comma-joined; of nothing where there is none. A null or empty text, or one without words, has no words and no hit.
    Items with a null id or no words are left out, repeated items count once. Rows without doc_id and rows that repeat one
    are each answered by their own text. Other columns are left out; empty tables are allowed.
    """
    docs = with_text_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text_id")
    phrases, terms, index = phrase_index(docs.select(F.col("text_id").alias("doc_id"), "text"), benchmark, window)
    spans = materialize(phrase_matches(phrases, terms, index), "phrase-hits")
    hit = spans.select("doc_id", F.explode(F.sequence("begin", "end")).alias("pos")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    items = spans.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    found = hit.join(items, "doc_id")
    sizes = index.filter(F.col("term_id") == END_ID).groupBy(F.col("doc_id").alias("text_id")).agg(F.max("pos").cast("long").alias("size"))
    out = docs.select("doc_id", "text_id").join(sizes, "text_id", "left").join(found.withColumnRenamed("doc_id", "text_id"), "text_id", "left")
    out = out.withColumns({"n_words": F.coalesce("size", F.lit(0).cast("long")), "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long")})
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with id or without, all columns unchanged, that hold no window of the benchmark."""
    name = fresh(docs, "text_id")
    rows = with_text_id(docs, name)
    texts = rows.select(F.col(name).alias("doc_id"), "text")
    bad = materialize(phrase_matches(*phrase_index(texts, benchmark, window)).select("doc_id").distinct(), "contaminated")
    return rows.join(small(bad.withColumnRenamed("doc_id", name)), name, "left_anti").select(*docs.columns)
