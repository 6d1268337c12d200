"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A document's windows as long as an item are fingerprinted by SimHash over their word shingles.
Fingerprints meet the items' in a multi-index: with 8 blocks of 8 bits and radius 23, two fingerprints
within the radius differ by at most 2 bits in some block, so the items' blocks are entered with all
values within 2 bits and every fingerprint within the radius is found by plain equality of a block.
Candidates are confirmed by the exact weighted Jaccard similarity of the shingle multisets.

A fingerprint's bits follow the similarity only where no shingle outweighs the others. So where the window
or the item holds a shingle twice, the index is not asked: such pairs meet by the shingle that the window
begins with, whatever their fingerprints. Windows without a shingle of any item of their length are not
fingerprinted; that loses nothing, as a passing window can be moved to begin at its first shared shingle.

The documents are read once, whatever the number of items, in chunks of ``CHUNK`` shingles (with what
windows need beside), so a long text costs in proportion. The three tables made from the benchmark are
broadcast if they have few enough rows or shingles. Where they have more, narrow rows are shuffled: shingles go alone
to meet the items', and what is found of a chunk comes back to it; fingerprints go without their windows, which are
stored and joined by the candidates. A text is then sent some three times (its shingles, and a chunk with findings).

Defined results: null and empty texts have no windows; a text shorter than an item is one window; an
item of fewer than ``words`` words is not searched for; repeated rows are judged alike; null ids and
extra columns are left alone (key columns are not to be named like those of this module: item, seed, cell and the like);
empty tables give no rows. Words are compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.jaccard import word_hashes
from chalkline.session import cut

RADIUS, BLOCK_BITS, NEAR_BITS = 23, 8, 2
_BLOCKS = 64 // BLOCK_BITS
#: Shingles of a text that are looked at in one row.
CHUNK = 4096
#: Most rows of the shingle and index tables, shingles of the item table, and keys to drop that are broadcast (some 64 MB each).
BROADCAST_ROWS, BROADCAST_SHINGLES = 1_000_000, 4_000_000


def shingles(hashes: str, words: int) -> str:
    """SQL: hashes of all runs of ``words`` words, in order, repeats included."""
    parts = ", ".join([*(["x"]), *[f"get({hashes}, i + {k})" for k in range(1, words)]])
    return f"transform(slice({hashes}, 1, cast(greatest(size({hashes}) - {words - 1}, 0) as int)), (x, i) -> xxhash64({parts}))"


def simhash(array: str) -> str:
    """SQL: 64-bit SimHash of an array of hashes; a repeated hash weighs as often as it is there.

    Four bits are counted at once, in 16-bit lanes of a long; arrays too long for a lane are counted bit by bit.
    """
    lanes = "(shiftrightunsigned(x, 4 * q) & 15L) * 35185445863425L & 281479271743489L"
    sums = f"transform(sequence(0, 15), q -> aggregate({array}, 0L, (n, x) -> n + ({lanes})))"
    of_lanes = f"get(transform(array({sums}), s -> aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * (shiftrightunsigned(get(s, b div 4), 16 * (b % 4)) & 65535L) > size({array}), shiftleft(1L, b), 0L))), 0)"
    ones = f"aggregate({array}, 0, (n, x) -> n + cast(shiftrightunsigned(x, b) & 1L as int))"
    by_bit = f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {ones} > size({array}), shiftleft(1L, b), 0L))"
    return f"coalesce(if(size({array}) < 32768, {of_lanes}, {by_bit}), 0L)"


def similarity(a: str, b: str) -> str:
    """SQL: weighted Jaccard of two multisets, sum of lesser over sum of greater counts."""
    lesser = f"least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x)))"
    return f"aggregate(array_intersect({a}, {b}), 0, (n, x) -> n + {lesser}, n -> n / (size({a}) + size({b}) - n))"


def _items(benchmark: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(item, item_id, item_words, item_shingles, item_plain, item_print), one row for each distinct item."""
    items = benchmark.select(F.col(key).alias("item_id"), F.expr(word_hashes(f"lower(cast(`{text}` as string))")).alias("_h"))
    items = items.select("item_id", F.size("_h").alias("item_words"), F.expr(shingles("_h", words)).alias("item_shingles"))
    items = items.where(f"item_words >= {words}").distinct()
    return items.select(
        F.xxhash64("item_id", "item_shingles").alias("item"), "item_id", "item_words", "item_shingles",
        F.expr(_PLAIN.format("item_shingles")).alias("item_plain"), F.expr(simhash("item_shingles")).alias("item_print"),
    )


_PLAIN = "size(array_distinct({0})) = size({0})"
_VALUE = f"shiftrightunsigned({{0}}, {BLOCK_BITS} * b) & {2**BLOCK_BITS - 1}L"


def _near_values() -> list[int]:
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= NEAR_BITS]


def _index(items: DataFrame) -> DataFrame:
    """(cell, way, item, item_print, item_plain): blocks with all near values (ways 0 to 7), and shingles (way 8)."""
    near = F.array(*[F.lit(m).cast("bigint") for m in _near_values()])
    rows = items.select("item", "item_words", "item_shingles", "item_print", "item_plain", near.alias("near"))
    blocks = rows.where("item_plain").select("*", F.explode(F.sequence(F.lit(0), F.lit(_BLOCKS - 1))).alias("b"))
    blocks = blocks.select("item", "item_words", "item_print", "item_plain", "b", F.explode(F.expr(f"transform(near, m -> ({_VALUE.format('item_print')}) ^ m)")).alias("v"))
    seeds = rows.select("item", "item_words", "item_print", "item_plain", F.lit(_BLOCKS).alias("b"), F.explode(F.array_distinct("item_shingles")).alias("v"))
    both = blocks.unionByName(seeds)
    return both.select(F.xxhash64("item_words", "b", "v").alias("cell"), F.col("b").alias("way"), "item", "item_print", "item_plain")


def leaks(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(keys, item_id, word_start, similarity, distance): windows of ``docs`` that hold an item, the best of each item."""
    items = cut(_items(benchmark, item_key, item_text, words), rows=benchmark.count())
    size = items.agg(F.coalesce(F.max("item_words"), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.size("item_shingles")), F.lit(0)).alias("shingles"), F.count(F.lit(1)).alias("n")).first()
    reach = max(int(size.longest) - words + 1, 1)
    chunk = max(CHUNK, reach)

    seeds = items.select("item_words", F.explode("item_shingles").alias("seed")).distinct()
    index_rows = size.n * _BLOCKS * len(_near_values()) + size.shingles
    seeds_fit, index_fits = size.shingles <= BROADCAST_ROWS, index_rows <= BROADCAST_ROWS
    df = docs.select(*keys, F.expr(word_hashes(f"lower(cast(`{text}` as string))")).alias("_h"))
    if not (seeds_fit and index_fits):  # by these a text's rows are found again after a shuffle; equal rows may share them
        df = df.withColumns({"_row1": F.xxhash64(*keys, "_h"), "_row2": F.xxhash64(F.lit(1), *keys, "_h")})
    row = [] if seeds_fit and index_fits else ["_row1", "_row2"]
    df = df.select(*keys, *row, F.expr(shingles("_h", words)).alias("_s"))
    cuts = f"transform(sequence(0, greatest(size(_s) - 1, 0) div {chunk}), k -> named_struct('own', k * {chunk}, 'from', greatest(k * {chunk} - {reach}, 0), 'part', slice(_s, cast(greatest(k * {chunk} - {reach}, 0) + 1 as int), {chunk + 2 * reach})))"
    df = df.select(*keys, *row, F.size("_s").alias("_n"), F.explode(F.expr(cuts)).alias("_c"))
    # outer: else a filter on the array size, worked out anew from the text, goes below
    own = F.posexplode_outer(F.expr(f"slice(_c.part, cast(_c.own - _c.from + 1 as int), {chunk})")).alias("_k", "_seed")
    if seeds_fit:
        df = df.select(*keys, *row, "_n", "_c", own).join(F.broadcast(seeds), F.col("_seed") == F.col("seed"))
    else:  # shingles travel alone, and what is found comes back to its chunk
        met = df.select(*row, F.col("_c.own").alias("_own"), own).join(seeds, F.col("_seed") == F.col("seed"))
        met = met.groupBy(*row, "_own").agg(F.collect_set(F.struct("_k", "item_words", "seed")).alias("_met")).withColumnsRenamed({c: f"{c}_" for c in row})
        here = [df[c] == met[f"{c}_"] for c in row] + [df["_c.own"] == met["_own"]]
        df = df.join(met, here).select(*keys, *row, "_n", "_c", F.inline("_met"))
    start = f"greatest(least(_c.own + _k, _n - (item_words - {words - 1})), 0)"
    # a generator of one row: without it the optimizer would cut the window anew wherever it is used
    window = f"array(named_struct('word_start', {start}, 'window', slice(_c.part, cast({start} - _c.from + 1 as int), item_words - {words - 1})))"
    df = df.select(*keys, *row, "item_words", "seed", F.inline(F.expr(window)))
    prints = f"array(named_struct('print', {simhash('window')}, 'plain', {_PLAIN.format('window')}))"
    df = df.select(*keys, *row, "item_words", "seed", "word_start", "window", F.inline(F.expr(prints)))

    place = ["item_words", "seed", "word_start"]
    windows = df
    if not index_fits:  # fingerprints travel without their windows
        windows = cut(df)
        df = windows.select(*row, *place, "print", "plain").distinct()
    carried = [*keys, *row, *place, "window"] if index_fits else [*row, *place]
    ways = F.expr(f"sequence(if(plain, 0, {_BLOCKS}), {_BLOCKS})")
    df = df.select(*carried, "print", "plain", F.explode(ways).alias("b"))
    df = df.withColumn("cell", F.expr(f"xxhash64(item_words, b, if(b = {_BLOCKS}, seed, {_VALUE.format('print')}))"))
    index = _index(items)
    pairs = df.join(F.broadcast(index) if index_fits else index, "cell").where("b = way")
    pairs = pairs.withColumn("distance", F.expr("cast(bit_count(print ^ item_print) as int)"))
    # a pair that several blocks bring is taken from the first of them
    first = f"array_position(transform(sequence(0, {_BLOCKS - 1}), b -> bit_count({_VALUE.format('(print ^ item_print)')}) <= {NEAR_BITS}), true) - 1"
    pairs = pairs.where(F.expr(f"if(b = {_BLOCKS}, not (plain and item_plain), distance <= {RADIUS} and {first} = b)"))
    if not index_fits:
        pairs = pairs.select(*row, *place, "item", "distance").withColumnsRenamed({c: f"{c}_" for c in [*row, *place]})
        pairs = windows.join(pairs, [windows[c] == pairs[f"{c}_"] for c in [*row, *place]])
    pairs = pairs.select(*keys, "item", "word_start", "window", "distance")
    held = items.select("item", "item_id", "item_shingles")
    pairs = pairs.join(F.broadcast(held) if size.shingles <= BROADCAST_SHINGLES else held, "item")
    pairs = pairs.withColumn("similarity", F.expr(similarity("window", "item_shingles"))).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("word_start")).alias("before"), "distance")).alias("best")
    return pairs.groupBy(*keys, "item_id").agg(best).select(
        *keys, "item_id", (-F.col("best.before")).alias("word_start"), F.col("best.similarity").alias("similarity"), F.col("best.distance").alias("distance")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark item; null ids and repeated rows included."""
    one, two = F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))
    named = docs.select(one.alias("_one"), two.alias("_two"), F.col(text).alias("_text"))
    gone = cut(leaks(named, benchmark, ["_one", "_two"], "_text").select("_one", "_two").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, (one == gone["_one"]) & (two == gone["_two"]), "left_anti")
