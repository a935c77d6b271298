"""Line dedup with a segment-partition edit join. DataFrame functions only.

Equal lines are one class. A line of n characters allows t(n) edits; t grows in bands of n. Two different lines link if
they are within the shorter one's t edits of each other.

1. Of any t + 1 segments of a line, in order, some segment i is unharmed in a line within t edits, with exactly i edits
   before it and so at most t - i behind it. Seen from the line's start it has moved by at most i characters, seen from
   the end by at most t - i. So the first segments are placed from the start and the last ones from the end, and only
   0, 1, ..., 1, 0 shifts of them need probing. Segments are as long as the least length of the line's bucket of lengths
   allows, so that one set of probes serves all lengths of a bucket; a line also probes the bucket below if it is near.
2. Distinct lines are indexed by their segments and probe with the substrings that could be one. Keys that more than
   HOT index lines share are set apart before anything is joined: there a line meets the key's earliest line alone.
3. A line with a hot segment that is not found near such an earliest line is taken up again in regions (halves, quarters
   and eighths of the line), each cut into t + 1 segments of its own. The index line chooses the region whose segments
   are the rarest, and the others probe every region. The lemma holds in each region, so no link is lost, and lines that
   share most of their text but differ in one place meet there only with their like.
4. What meets is verified by a banded bit-parallel automaton: for each number of errors a bit set of the diagonals still
   reachable, advanced by one character at a time. Before that, pairs whose letter counts or character parities are too
   far apart for so few edits are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, small, with_row_key

THRESHOLD = 2
MIN_CHARS = 20
#: The query's rule: lines of at least so many characters allow so many edits; shorter ones are compared for equality.
BANDS = ((12, 1), (24, 2), (96, 3))
#: Keys of more index lines than this are hot.
HOT = 256
#: Regions by which lines with hot segments are told apart: so many equal parts of a line.
PARTS = (2, 4, 8)
_INK = r"[^\x20\x09-\x0D]"


def edit_within(a: Column, b: Column, threshold: int, allowed: Column | None = None) -> Column:
    """Whether a and b are at most ``threshold`` (where given, ``allowed``, which is no more) insertions, deletions and
    substitutions of code points apart.

    For each character of b, a bit mask tells which diagonals of the band match it. The automaton's state packs, for
    each number of errors, the diagonals reachable into one whole number.
    """
    t, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    x, y = _chars(a), _chars(b)
    none = F.lit(None).cast("string")
    masks = None
    for k in range(width):  # a's characters, moved so that those of this diagonal stand beside b's
        moved = F.concat(F.array_repeat(none, t - k), x) if k < t else F.slice(x, k - t + 1, F.greatest(F.size(x), F.lit(1)))
        hit = F.transform(F.zip_with(y, moved, lambda c, d: c == d), _bit(1 << k))
        masks = hit if masks is None else F.zip_with(masks, hit, lambda m, h: F.coalesce(m, F.lit(0)).bitwiseOR(F.coalesce(h, F.lit(0))))
    masks = F.transform(F.slice(masks, F.lit(1), F.size(y)), lambda m: m.cast("bigint"))

    def step(acc: Column, mask: Column) -> Column:
        reached: list[Column] = []
        for d in range(t + 1):
            r = F.shiftright(acc, width * d).bitwiseAND(mask)
            if d:
                less = F.shiftright(acc, width * (d - 1)).bitwiseAND(F.lit(full))
                r = r.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(reached[-1], 1)).bitwiseAND(F.lit(full))
            reached.append(r)
        packed = reached[0]
        for d in range(1, t + 1):
            packed = packed.bitwiseOR(F.shiftleft(reached[d], width * d))
        return F.when(acc == 0, acc).otherwise(packed)

    start = sum((((1 << (d + 1)) - 1) << t & full) << (width * d) for d in range(t + 1))
    gap = F.char_length(a) - F.char_length(b)
    errors = F.lit(t) if allowed is None else allowed
    accepting = _shift_left(F.lit(1).cast("bigint"), gap + t + width * errors)
    reached = F.aggregate(masks, F.lit(start).cast("bigint"), step)
    return F.when(F.abs(gap) <= errors, reached.bitwiseAND(accepting) != 0).otherwise(F.lit(False))


#: Letters whose counts (modulo 8) sift what meets; any letters do, frequent ones sift best.
SKETCH_LETTERS = "entaiors"
#: Counted too once only lines that met something are left.
MORE_LETTERS = "hdlucmpfgbywvkx"
#: Four bits for each count, of which two counts' differ in as many as the counts do, going round at 8.
_ROUND = sum(code << 4 * k for k, code in enumerate((0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000)))
_COUNTS = (1 << 60) - 1


def sketch(line: Column, t: Column, letters: str = SKETCH_LETTERS) -> Column:
    """Counts of letters modulo 8, four bits each, and t, the edits that the line allows (up to 7), above them."""
    out = F.shiftleft(t.cast("bigint"), 60)
    for k, letter in enumerate(letters):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        code = F.call_function("shiftright", F.lit(_ROUND).cast("bigint"), n.bitwiseAND(F.lit(7)) * 4).bitwiseAND(F.lit(15).cast("bigint"))
        out = out.bitwiseOR(F.shiftleft(code, 4 * k))
    return out


def sketches_alike(a: Column, b: Column) -> Column:
    """Whether two lines' counts are near enough for the edits that both allow; an edit adds two at most."""
    return counts_apart(a, b) <= 2 * F.least(F.shiftright(a, 60), F.shiftright(b, 60))


def counts_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_COUNTS)))


def _bit(bit: int):
    return lambda hit: F.when(hit, F.lit(bit)).otherwise(F.lit(0))


def _shift_left(bits: Column, by: Column) -> Column:
    return F.call_function("shiftleft", bits, by)


def _chars(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def pair_classes(line: Column) -> Column:
    """Which of 128 classes each two neighbouring characters are of."""
    x = _chars(line)
    return F.zip_with(x, F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))), lambda c, d: F.pmod(F.hash(c, d), F.lit(128)))


def parity(pairs: Column) -> Column:
    """Two times 64 bits: which classes of character pairs occur an odd number of times. An edit changes four bits at most."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    bits = [F.aggregate(F.filter(pairs, keep), zero, lambda acc, v: acc.bitwiseXOR(_shift_left(one, v.bitwiseAND(F.lit(63))))) for keep in (lambda v: v < 64, lambda v: v >= 64)]
    return F.struct(bits[0].alias("a"), bits[1].alias("b"))


def parities_apart(p: Column, q: Column) -> Column:
    return F.bit_count(p["a"].bitwiseXOR(q["a"])) + F.bit_count(p["b"].bitwiseXOR(q["b"]))


def allowed_edits(n: Column, bands: Sequence[tuple[int, int]]) -> Column:
    """How many edits a line of n characters allows; 0 where only equal lines count."""
    out = F.lit(0)
    for least, edits in sorted(bands):
        out = F.when(n >= least, F.lit(edits)).otherwise(out)
    return out


def bucket(n: Column) -> Column:
    """The least length of n's bucket: multiples of 8 and, for longer lines, eight steps to each doubling."""
    step = _shift_left(F.lit(1), F.greatest(F.length(F.bin(n)) - 4, F.lit(3)))
    return (F.floor(n / step) * step).cast("int")


def layouts(n: Column, bands: Sequence[tuple[int, int]], sides: Sequence[int]) -> Column:
    """Distinct (t, lo) of all lengths near enough to n for a link: shorter ones (side -1), longer ones (1) and its own (0)."""
    most = max(t for _, t in bands)
    near = []
    for d in range(-most, most + 1):
        if ((d > 0) - (d < 0)) in sides:
            m = n + d
            ok = (allowed_edits(F.least(m, n), bands) >= abs(d)) & (allowed_edits(m, bands) > 0)
            near.append(F.when(ok, F.struct(allowed_edits(m, bands).alias("t"), bucket(m).alias("lo"))))
    return F.array_distinct(F.array_compact(F.array(*near)))


def _key(lo: Column, t: int, i: int, region: Column | int, line: Column, begin: Column, size: Column) -> Column:
    """A hash of a segment's layout, number and text; its last bit is 0."""
    region = F.lit(region) if isinstance(region, int) else region
    return F.xxhash64(lo, F.lit(t * 64 + i), region, F.substring(line, begin + 1, size)).bitwiseAND(F.lit(-2))


def _width(lo: Column, t: int) -> Column:
    return F.floor(lo / (t + 1)).cast("int")


def _begin(n: Column, w: Column, t: int, i: int) -> Column:
    """Where segment i of a line of n characters begins (from 0): the first ones from the start, the last ones from the end."""
    return w * i if i <= t - i else n - w * (t + 1 - i)


def segment_keys(probes: Column, t: int) -> Column:
    """The keys under which a line is indexed: those of its own bucket's probes (the first ones) that are not shifted."""
    shifts = [min(i, t - i) for i in range(t + 1)]
    places = [sum(2 * k + 1 for k in shifts[:i]) + shifts[i] for i in range(t + 1)]
    return F.array(*[F.get(probes, F.lit(p)).bitwiseAND(F.lit(-2)) for p in places])


def probe_keys(line: Column, n: Column, lo: Column, t: int, mark: int = 0) -> Column:
    """The keys of every substring that could be a segment of a line of bucket lo within t edits, with ``mark`` as last bit."""
    w = _width(lo, t)
    keys = [_key(lo, t, i, 0, line, _begin(n, w, t, i) + s, w) for i in range(t + 1) for s in range(-min(i, t - i), min(i, t - i) + 1)]
    return F.array(*[k.bitwiseOR(F.lit(mark)) for k in keys])


def _regions() -> Column:
    """number, parts, place (counted from the nearer end), left: the regions of a line."""
    found = [(p, min(k, p - 1 - k), k < p // 2) for p in PARTS for k in range(p)]
    return F.array(*[F.struct(F.lit(no + 1).alias("number"), F.lit(p).alias("parts"), F.lit(k).alias("place"), F.lit(left).alias("left")) for no, (p, k, left) in enumerate(found)])


def region_keys(line: Column, n: Column, lo: Column, t: int, region: Column, probe: bool) -> Column:
    """The keys of a region's segments, placed from the nearer end of the line: as indexed, or all that could be one."""
    size = F.floor(lo / region["parts"]).cast("int")
    w = F.greatest(F.floor(size / (t + 1)).cast("int"), F.lit(1))
    base = size * region["place"]
    begin = lambda i, s: F.when(region["left"], base + w * i + s).otherwise(n - base - w * (i + 1) + s)
    return F.array(*[_key(lo, t, i, region["number"], line, begin(i, s), w) for i in range(t + 1) for s in (range(-i, i + 1) if probe else (0,))])


def _by_threshold(t: Column, bands: Sequence[tuple[int, int]], keys) -> Column:
    """keys(t) for the t of each row; nothing for 0."""
    out = F.array().cast("array<bigint>")
    for edits in sorted({e for _, e in bands}):
        out = F.when(t == edits, keys(edits)).otherwise(out)
    return out


def _placed(docs: DataFrame, key: str) -> DataFrame:
    """at (struct of the row's key and the line's number), line, k1, k2 of every line with ink."""
    lines = docs.select(F.col(key).alias("row"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(_INK))
    return lines.select(F.struct("row", "line_no").alias("at"), "line", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), F.col("line")).alias("k2"))


def distinct_lines(placed: DataFrame, bands: Sequence[tuple[int, int]]) -> DataFrame:
    """One row for each distinct line: k1, k2, first (its first place), n, and for lines that allow edits s (letter
    counts), t (edits allowed) and probes (keys to look up; the last bit is 1 where the bucket is its own, and those come first)."""
    rows = placed.select("k1", "k2", "at", "line", F.char_length("line").alias("n"))
    rows = rows.withColumns({"t": allowed_edits(F.col("n"), bands), "lo": bucket(F.col("n"))})
    line, n, t, lo = (F.col(c) for c in ("line", "n", "t", "lo"))
    own = _by_threshold(t, bands, lambda e: probe_keys(line, n, lo, e, mark=1))
    # Few lines are so near to the least length of their bucket that a linked line can be in the one below.
    least = n - max(e for _, e in bands)
    crosses = (t > 0) & ((bucket(F.greatest(least, F.lit(1))) != lo) | (allowed_edits(least, bands) != t))
    below = F.array_except(layouts(n, bands, (-1,)), F.array(F.struct("t", "lo")))
    keys = lambda x: _by_threshold(x["t"], bands, lambda e: probe_keys(line, n, x["lo"], e))
    rows = rows.withColumn("below", F.when(crosses, below))
    some = F.col("below")
    # A lambda is much slower than one lookup, and hardly any line has two layouts below its own.
    other = F.when(F.size(some) == 1, keys(F.get(some, F.lit(0)))).otherwise(F.flatten(F.transform(some, keys)))
    rows = rows.select("k1", "k2", "at", F.when(t > 0, sketch(line, t)).alias("s"), "t", own.alias("own"), F.when(F.size(some) > 0, other).alias("other"))
    rows = rows.select("k1", "k2", "at", "s", "t", F.when(F.col("other").isNull(), F.col("own")).otherwise(F.concat("own", "other")).alias("probes"))
    held = [F.first(c).alias(c) for c in ("s", "t", "probes")]
    return rows.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.count("*").alias("n"), *held)


def line_texts(docs: DataFrame, key: str, distinct: DataFrame, ids: DataFrame, bands: Sequence[tuple[int, int]]) -> DataFrame:
    """k1, first, line, n, t, lo, s, more, parity of the distinct lines whose k1 is in ids."""
    wanted = distinct.join(small(ids), "k1", "left_semi").select("k1", "first.row", "first.line_no", "s", "t")
    wanted = materialize(wanted, "line-places")
    some = docs.select(F.col(key).alias("row"), "text").join(small(wanted.select("row").distinct()), "row", "left_semi")
    texts = some.select("row", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).join(small(wanted), ["row", "line_no"]).dropDuplicates(["k1"])
    texts = texts.withColumn("n", F.char_length("line")).withColumn("lo", bucket(F.col("n"))).withColumn("pairs", pair_classes(F.col("line"))).withColumns({"parity": parity(F.col("pairs")), "more": sketch(F.col("line"), F.lit(0), MORE_LETTERS)})
    return materialize(texts.select("k1", F.struct("row", "line_no").alias("first"), "line", "n", "t", "lo", "s", "more", "parity"), "line-texts")


def _sifted(met: DataFrame, texts: DataFrame) -> DataFrame:
    """k1, other, allowed of the pairs of met(k1, other) whose letters and character pairs are not too far apart."""
    bits = texts.select("k1", F.struct("s", "more", "parity", "t").alias("u"))
    met = met.join(bits, "k1").join(bits.select(F.col("k1").alias("other"), F.col("u").alias("v")), "other").withColumn("allowed", F.least("u.t", "v.t"))
    return met.filter(_all_alike(F.col("u"), F.col("v"), F.col("allowed"))).select("k1", "other", "allowed")


def _all_alike(u: Column, v: Column, allowed: Column) -> Column:
    """Whether all letter counts and parities of two structs (s, more, parity) are near enough for so many edits."""
    counts = counts_apart(u["s"], v["s"]) + counts_apart(u["more"], v["more"]) <= 2 * allowed
    return counts & (parities_apart(u["parity"], v["parity"]) <= 4 * allowed)


def _verified(met: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """k1 of every line that is near an earlier one in a pair of met(k1, other, allowed)."""
    x = texts.select("k1", F.col("line").alias("x"), F.col("first").alias("x_at"))
    y = texts.select(F.col("k1").alias("other"), F.col("line").alias("y"), F.col("first").alias("y_at"))
    # Few pairs are left, each much work: they are spread over all tasks, and verified after that (a filter would move before it).
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.join(x, "k1").join(y, "other").repartition(tasks, "k1", "other")
    near = F.max(edit_within(F.col("x"), F.col("y"), most, F.col("allowed"))).alias("near")
    later = F.max(F.when(F.col("y_at") < F.col("x_at"), F.col("k1")).otherwise(F.col("other"))).alias("later")
    return found.groupBy("k1", "other").agg(near, later).filter("near").select(F.col("later").alias("k1")).distinct()


def near_lines(docs: DataFrame, key: str, distinct: DataFrame, bands: Sequence[tuple[int, int]]) -> DataFrame:
    """k1 of the distinct lines that are near an earlier one."""
    most = max(t for _, t in bands)
    index = distinct.select("k1", "s", F.explode(_by_threshold(F.col("t"), bands, lambda e: segment_keys(F.col("probes"), e))).alias("key"))
    probes = distinct.select(F.col("k1").alias("other"), F.col("s").alias("q"), F.explode("probes").alias("probe"))
    probes = probes.select("other", "q", F.col("probe").bitwiseAND(F.lit(-2)).alias("key"), (F.col("probe").bitwiseAND(F.lit(1)) == 1).alias("own"))
    alike = sketches_alike(F.col("s"), F.col("q"))
    apart = F.col("k1") != F.col("other")
    pair = (F.least("k1", "other").alias("k1"), F.greatest("k1", "other").alias("other"))

    hot = materialize(index.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "hot-segments")
    any_hot = hot.limit(1).count() > 0
    cold_index, cold_probes, hot_lines = index, probes, None
    if any_hot:
        few = small(hot)
        cold_index, cold_probes = index.join(few, "key", "left_anti"), probes.join(few, "key", "left_anti")
    once = F.when(F.col("own"), F.col("k1") < F.col("other")).otherwise(apart)
    met = cold_index.join(cold_probes, "key").filter(once & alike).select(*pair)
    if any_hot:
        in_hot = materialize(index.join(few, "key", "left_semi").select("key", "k1", "s"), "hot-index")
        asks = materialize(probes.join(few, "key", "left_semi").select("key", "other", "q"), "hot-probes")
        firsts = in_hot.join(distinct.select("k1", "first"), "k1").groupBy("key").agg(F.min(F.struct("first", "k1", "s")).alias("least"))
        hubs = firsts.select("key", "least.k1", "least.s")
        met = met.unionAll(asks.join(small(hubs), "key").filter(apart & alike).select(*pair))
        hot_lines = in_hot.select("k1").unionAll(asks.select("other")).distinct()
    met = materialize(met.distinct(), "line-pairs")
    ids = met.select("k1").unionAll(met.select("other"))
    texts = line_texts(docs, key, distinct, (ids if hot_lines is None else ids.unionAll(hot_lines)).distinct(), bands)
    near = materialize(_verified(_sifted(met, texts), texts, most), "near-lines")
    if not any_hot:
        return near

    line, n, lo = F.col("line"), F.col("n"), F.col("lo")
    held = texts.join(in_hot.select("k1").distinct(), "k1", "left_semi").withColumn("region", F.explode(_regions()))
    bits = F.struct("s", "more", "parity", "t")
    cut = held.select("k1", F.col("region.number").alias("region"), F.explode(_by_threshold(F.col("t"), bands, lambda e: region_keys(line, n, lo, e, F.col("region"), False))).alias("key"))
    cut = materialize(cut, "region-segments")
    counts = cut.groupBy("key").agg(F.count("*").alias("c"))
    rated = cut.join(counts, "key").groupBy("k1", "region").agg(F.max("c").alias("c"))
    chosen = rated.groupBy("k1").agg(F.min(F.struct("c", "region")).alias("best")).select("k1", F.col("best.region").alias("region"))
    rare = cut.join(chosen, ["k1", "region"]).select("k1", "key").join(texts.select("k1", "first", bits.alias("u")), "k1")
    left = asks.select(F.col("other").alias("k1")).distinct().join(near, "k1", "left_anti")
    left = texts.join(left, "k1", "left_semi").withColumn("layout", F.explode(layouts(n, bands, (-1, 0, 1)))).withColumn("region", F.explode(_regions()))
    keys = F.explode(_by_threshold(F.col("layout.t"), bands, lambda e: region_keys(line, n, F.col("layout.lo"), e, F.col("region"), True)))
    sought = left.select(F.col("k1").alias("other"), F.col("first").alias("place"), bits.alias("v"), keys.alias("key"))
    allowed = F.least("u.t", "v.t")
    # Of a linked pair that shares hot segments alone both lines are indexed and both probe; the later one's probes are enough.
    still = rare.join(sought, "key").filter((F.col("first") < F.col("place")) & _all_alike(F.col("u"), F.col("v"), allowed))
    again = materialize(still.select(*pair, allowed.alias("allowed")).distinct(), "region-pairs")
    return near.unionAll(_verified(again, texts, most)).distinct()


def removed_lines(docs: DataFrame, key: str, bands: Sequence[tuple[int, int]]) -> DataFrame:
    """row, removed (sorted line numbers from 0) of the rows of docs(text, and ``key`` of with_row_key) that lose lines."""
    placed = _placed(docs, key)
    distinct = materialize(distinct_lines(placed, bands), "distinct-lines")
    near = materialize(near_lines(docs, key, distinct, bands), "later-lines") if bands else None
    spots = placed.select("k1", "k2", "at")
    again = distinct.filter("n > 1").select("k1", "k2", "first")
    gone = spots.join(again, ["k1", "k2"]).filter(F.col("at") > F.col("first")).select("at")
    if near is not None:
        gone = gone.unionAll(spots.join(small(near), "k1", "left_semi").select("at"))
    return gone.groupBy("at.row").agg(F.array_sort(F.collect_set("at.line_no")).alias("removed"))


def _rule(threshold: int, min_chars: int, bands: Sequence[tuple[int, int]] | None) -> Sequence[tuple[int, int]]:
    return ((min_chars, threshold),) if bands is None else bands


def dedup_report(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, bands: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, removed for each row of documents(doc_id, text); the rule is that of dedup_lines."""
    rows = with_row_key(docs.select("doc_id", "text"), "row")
    gone = removed_lines(rows, "row", _rule(threshold, min_chars, bands))
    n_lines = F.greatest(F.coalesce(F.size(F.split("text", "\n")), F.lit(0)), F.lit(0))
    out = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "row", n_lines.cast("long").alias("n_lines")).join(gone, "row", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, bands: Sequence[tuple[int, int]] | None = None, keep_emptied: bool = True) -> DataFrame:
    """The rows of docs, all columns but text unchanged, without the lines that repeat an earlier one.

    A line (text between line ends, case and spaces as they are) is removed if an equal line, or one within
    ``threshold`` edits where both have ``min_chars`` code points or more, stands earlier: at a smaller doc_id, or
    further up in the same document. ``bands`` gives several (min_chars, threshold) instead; the shorter line's counts.
    Lines are judged on the input, not on what is left. Lines without ink are kept. A null text stays null and an
    empty one empty; a text that loses all its lines becomes empty, or without ``keep_emptied`` its row is left out (so is
    one of which only lines without ink are left). A null doc_id counts as the largest and names no
    document: several such rows are compared like rows of different ids, in an order by a hash of their texts. Rows with
    equal doc_id and text are the same document and never repeat each other; rows of one doc_id with different texts are
    compared in the order of that hash. An empty table gives an empty result.
    """
    key = fresh(docs, "row_key")
    rows = with_row_key(docs, key)
    removed = fresh(rows, "removed")
    gone = removed_lines(rows, key, _rule(threshold, min_chars, bands)).select(F.col("row").alias(key), F.col("removed").alias(removed))
    out = rows.join(gone, key, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col(removed), i)), "\n")
    out = out.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(kept))
    if not keep_emptied:
        out = out.filter(F.col(removed).isNull() | F.col("text").rlike(_INK))
    return out.select(*docs.columns)
