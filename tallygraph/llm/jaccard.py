"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two sets of at least ``num``/``den`` Jaccard similarity share an element among the first n - ceil(num * n / den) + 1
of each, in any one order of all elements. The order here is rare first, so most sets begin with elements that no
other set has and meet nobody.

1. Equal sets are one class, known by a 128-bit key (signature and size); only classes are joined.
2. Screen: in the order "those of a fixed share of elements that only one set has, then the rest", a set whose whole
   prefix is of the first kind has no partner. Only that share of elements is counted over the corpus.
3. Sets that remain are ordered by true frequency among themselves, and their prefixes become posting lists.
4. A list gives those pairs of which its element can be the first shared one: the smaller set must have enough elements
   left from there on (it leads), which few members of a list of frequent elements have. Lists with few leads give these
   pairs; one with many first gives pairs with one central member (few elements of its own). Pairs that pass the length
   and positional filters are verified once each, after a suffix filter.
5. Long lists then give only pairs whose ends are still in different components, so that a large group of copies
   costs about its size, not its square, while no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, ROW_KEY, byte_view, fresh, materialize, mix64, small, text_slices, window_hashes, with_row_key, word_hashes, word_spans
from .components import components

#: A posting list of at most so many leads gives all its pairs at once.
SHORT_LIST = 32


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles (ASCII letters lower-cased); a shorter text is one shingle."""
    data, off = byte_view(texts)
    data = LOWER[data]
    starts, ends, row = word_spans(data, off, NON_SPACE)
    words = word_hashes(data, starts, ends)
    grams = window_hashes(words, width)
    begin = np.searchsorted(row, np.arange(len(off)))
    out = []
    for b, e in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if e - b >= width:
            h = np.sort(grams[b : e - width + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif e > b:
            out.append(window_hashes(words[b:e], e - b) ^ np.uint64(e - b))
        else:
            out.append(words[:0])
    return out


def signature(hashes: np.ndarray) -> int:
    """An order-free 64-bit key of a set, as a signed number."""
    return int(mix64(np.array([mix64(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(hashes))]))[0].astype(np.int64))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64())], ["row", "n", "sig"])

    return docs.mapInArrow(run, f"row {ROW_KEY}, n long, sig long")


def _sampled_elements(docs: DataFrame, width: int, every: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            some = [s[s % np.uint64(every) == 0] for s in sets]
            sigs = np.repeat(np.array([signature(s) for s in sets], np.int64), [len(s) for s in some])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64)), pa.array(sigs)], ["h", "sig"])

    return docs.mapInArrow(run, "h long, sig long")


def _element_lists(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            cols = [batch.column("row"), pa.array([signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(cols, ["row", "sig", "n", "hs"])

    return docs.mapInArrow(run, f"row {ROW_KEY}, sig long, n long, hs array<long>")


class _Threshold:
    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: str) -> Column:
        return F.expr(f"{n} - ({self.num} * {n} + {self.den - 1}) div {self.den} + 1")

    def common(self, x: str, y: str) -> Column:
        """The least number of common elements of linked sets of sizes x and y."""
        return F.expr(f"({self.num} * ({x} + {y}) + {self.num + self.den - 1}) div {self.num + self.den}")

    def leads(self) -> Column:
        """Whether the element of a posting (n: size, r: its place from 0) can be the first that the set shares with a linked one
        that is not smaller: so many elements must be left from there on."""
        return F.col("n") - F.col("r") >= self.common("n", "n")

    def may_link(self, x: str, y: str) -> Column:
        """Length and positional filters on two postings of one element, taken as the first that both sets share in the common
        order (a linked pair's first shared element is in both prefixes, so some list has it as that)."""
        length = F.expr(f"{self.den} * least({x}.n, {y}.n) >= {self.num} * greatest({x}.n, {y}.n)")
        return length & (F.expr(f"least({x}.n - {x}.r, {y}.n - {y}.r)") >= self.common(f"{x}.n", f"{y}.n"))

    def verify(self, pairs: DataFrame, lists: DataFrame) -> DataFrame:
        """Those of pairs(a, b) that link; lists(sig, n, hs) has each set's shared elements, sorted."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                xs, ys = batch.column("x"), batch.column("y")
                x_off, y_off = xs.offsets.to_numpy(), ys.offsets.to_numpy()
                x_all, y_all = xs.values.to_numpy(zero_copy_only=False), ys.values.to_numpy(zero_copy_only=False)
                keep = np.zeros(batch.num_rows, bool)
                for k, size in enumerate((batch.column("nx").to_numpy() + batch.column("ny").to_numpy()).tolist()):
                    x, y = x_all[x_off[k] : x_off[k + 1]], y_all[y_off[k] : y_off[k + 1]]
                    need = -(-num * size // (num + den))
                    if suffix_bound(x, y) >= need:
                        keep[k] = len(np.intersect1d(x, y, assume_unique=True)) >= need
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        x = lists.select(F.col("sig").alias("a"), F.col("n").alias("nx"), F.col("hs").alias("x"))
        y = lists.select(F.col("sig").alias("b"), F.col("n").alias("ny"), F.col("hs").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "nx", "ny", "x", "y").mapInArrow(run, "a long, b long")


def suffix_bound(x: np.ndarray, y: np.ndarray, parts: int = 8) -> int:
    """An upper bound on the common elements of two sorted sets: pivots of one cut both into parts, and no part shares
    more than its smaller side holds."""
    if not len(x) or not len(y):
        return 0
    pivots = y[np.arange(1, parts) * len(y) // parts]
    cx = np.diff(np.concatenate(([0], np.searchsorted(x, pivots), [len(x)])))
    cy = np.diff(np.concatenate(([0], np.searchsorted(y, pivots), [len(y)])))
    return int(np.minimum(cx, cy).sum())


def _doc_id(row: str) -> Column:
    return F.when(F.col(row)["copy"] == 0, F.col(row)["id"])


def _grouped(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """row, n, component_id and least (the component's least row) for each of docs(row, text); see jaccard_components."""
    t = _Threshold(num, den)
    sets = materialize(_sets(docs, width), "sets")
    # Null ids come last among keys, so a class has no id only if none of its rows has.
    classes = sets.filter("n > 0").groupBy("sig", "n").agg(F.min("row").alias("row"))
    classes = materialize(classes, "classes")

    # A prefix is a share of 1 - num/den of a set; two and a half times as much of it is screened.
    every = max(1, int(0.4 * den / (den - num))) if num < den else 1 << 20
    alone = _sampled_elements(docs, width, every).groupBy("h").agg(F.min("sig").alias("sig"), F.max("sig").alias("other")).filter("sig = other")
    own = alone.groupBy("sig").agg(F.count("*").alias("own"))
    left = classes.join(own, "sig", "left").filter(F.coalesce("own", F.lit(0)) < t.prefix("n")).select("sig", "row")
    left = materialize(left, "screened")

    texts = docs.join(small(left.select("row").distinct()), "row", "left_semi")
    lists = _element_lists(texts, width).join(small(left), ["sig", "row"], "left_semi").select("sig", "n", "hs")
    lists = materialize(lists, "lists")
    elements = lists.select("sig", "n", F.explode("hs").alias("h"))
    shared = elements.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = elements.join(shared, "h").groupBy("sig", "n").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("es"))
    ordered = ordered.withColumn("u", F.col("n") - F.size("es")).filter(F.col("u") < t.prefix("n"))
    ordered = materialize(ordered, "ordered")
    shared_lists = ordered.select("sig", "n", F.sort_array("es.h").alias("hs"))

    first = F.slice("es", F.lit(1), F.greatest(F.lit(0), (t.prefix("n") - F.col("u"))).cast("int"))
    postings = ordered.select("sig", "n", "u", F.posexplode(first).alias("k", "e")).select("sig", "n", "u", (F.col("u") + F.col("k")).alias("r"), F.col("e.h").alias("h"))
    postings = materialize(postings, "postings")
    lead = F.struct("u", "sig", "n", "r")
    sizes = postings.groupBy("h").agg(F.count("*").alias("c"), F.count_if(t.leads()).alias("leads"), F.min(F.when(t.leads(), lead)).alias("hub"))
    sizes = materialize(sizes.filter("c > 1 and leads > 0"), "posting-sizes")

    def pairs(rows: DataFrame, more: Column | None = None) -> DataFrame:
        how = (F.col("x.h") == F.col("y.h")) & (F.expr("x.n < y.n") | F.expr("x.n = y.n and x.sig < y.sig")) & t.may_link("x", "y")
        found = rows.filter(t.leads()).alias("x").join(rows.alias("y"), how if more is None else how & more)
        return found.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"))

    short = postings.join(sizes.filter(F.col("leads") <= SHORT_LIST).select("h"), "h", "left_semi")
    long = postings.join(sizes.filter(F.col("leads") > SHORT_LIST).select("h"), "h", "left_semi")
    hubs = sizes.filter(F.col("leads") > SHORT_LIST).select("h", "hub.*")
    to_hub = long.alias("x").join(hubs.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.sig") != F.col("y.sig")) & t.may_link("x", "y"))
    to_hub = to_hub.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"))
    links = materialize(t.verify(pairs(short).unionAll(to_hub).distinct(), shared_lists), "links")

    labels = components(links)
    if sizes.filter(F.col("leads") > SHORT_LIST).limit(1).count():
        placed = long.join(labels.withColumnRenamed("v", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        placed = materialize(placed, "long-postings")
        across = pairs(placed, F.col("x.label") != F.col("y.label")).distinct()
        more = materialize(t.verify(across, shared_lists), "links-across")
        if more.limit(1).count():
            labels = components(links.unionAll(more))

    placed = classes.join(labels.withColumnRenamed("v", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = placed.groupBy("label").agg(F.min(_doc_id("row")).alias("component_id"), F.min("row").alias("least"))
    found = placed.join(least, "label").select("sig", "n", "component_id", "least")
    out = sets.join(found, ["sig", "n"], "left")
    own_id = F.when(F.col("n") > 0, F.coalesce("component_id", _doc_id("row"))).otherwise(_doc_id("row"))
    return out.select("row", "n", own_id.alias("component_id"), "least")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents(doc_id, text).

    Two documents link when den * |intersection| >= num * |union| of their shingle sets; component_id is the least
    doc_id that links reach, the row's own included. A null or empty text, or one of white space, has no shingle,
    links with nothing and is its own component. A row with a null doc_id links like any other, and others may be
    reached through it; a component of such rows alone has a null component_id. Repeated rows are each answered. Other columns are left out. An empty table
    gives an empty result. Sets are told apart by 64-bit signature and size.
    """
    docs = with_row_key(docs.select("doc_id", "text"), "row").select("row", "text")
    found = _grouped(docs, width, num, den)
    return found.select(_doc_id("row").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns unchanged, without those that are not the first of their component: by doc_id, then by a
    hash of the text; rows without id come last. A row without shingles stays. Rows of one id are told apart by their
    texts; of rows with one id and one text, any one stays.
    """
    name = fresh(docs, "row_key")
    rows = with_row_key(docs, name)
    found = materialize(_grouped(rows.select(F.col(name).alias("row"), "text"), width, num, den).filter("n > 0").select("row", "least"), "near-duplicates")
    gone = found.filter(F.col("row") != F.col("least")).select(F.col("row").alias(name)).distinct()
    kept = rows.join(small(gone), name, "left_anti")
    again = found.filter(F.col("row") == F.col("least")).groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("row").alias(name))
    if again.limit(1).count():
        again = small(again)
        kept = kept.join(again, name, "left_anti").unionByName(kept.join(again, name, "left_semi").dropDuplicates([name]))
    return kept.select(*docs.columns)
