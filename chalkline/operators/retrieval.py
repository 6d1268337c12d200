"""Exact vector retrieval: per-index top-k, merged hits, score gate, winning index, context budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many queries at most are sent to the tasks as they are; more meet the vectors by cells and blocks.
QUERY_BLOCK = 4096
#: Vectors of a cell, and scores that stand in memory at once.
CELL, SCORES = 32_768, 1 << 22
SCORE_DIGITS = 9
_HITS = "query_id long, index_name string, chunk_id long, score double"


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


class _Best:
    """The k best of each index for each of some queries."""

    def __init__(self, ids: np.ndarray, wanted: np.ndarray, k: int) -> None:
        self.ids, self.wanted, self.k, self.found = ids, _unit(wanted), k, {}

    def add(self, chunk: np.ndarray, names: list[str], vectors: np.ndarray) -> None:
        step = max(1, SCORES // max(1, len(self.ids)))
        for start in range(0, len(chunk), step):
            part = slice(start, start + step)
            self._add(chunk[part], np.array(names[part], object), np.round(self.wanted @ _unit(vectors[part]).T, SCORE_DIGITS))

    def _add(self, chunk: np.ndarray, names: np.ndarray, score: np.ndarray) -> None:
        for name in dict.fromkeys(names.tolist()):
            at = np.flatnonzero(names == name)
            s, c = score[:, at], np.broadcast_to(chunk[at], (len(self.ids), len(at)))
            if name in self.found:
                s, c = np.hstack([self.found[name][0], s]), np.hstack([self.found[name][1], c])
            order = np.lexsort((c, -s))[:, : self.k]
            self.found[name] = np.take_along_axis(s, order, 1), np.take_along_axis(c, order, 1)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for name, (s, c) in self.found.items():
            n = s.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(self.ids, n)), pa.array([name] * s.size, pa.string()), pa.array(c.ravel()), pa.array(s.ravel())],
                ["query_id", "index_name", "chunk_id", "score"],
            )


def top_k_per_index(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, index_name, chunk_id, score): the k best of each index for each query.

    ``vectors``: (chunk_id, index_name, embedding); ``queries``: (query_id, embedding), a stated set. Up to
    ``QUERY_BLOCK`` queries go to the tasks that read the vectors. More are dealt into blocks and the vectors into
    cells, and each pair of a block and a cell is one group of bounded size; the driver sees neither. A task keeps the
    k best of what it reads, so k rows for each query, index and task (or cell) are shuffled, never scores.
    """
    plain = vectors.where("chunk_id is not null and embedding is not null").select(
        F.col("chunk_id").cast("long"), F.col("index_name").cast("string"), F.col("embedding").cast("array<float>")
    )
    asked = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("long"), F.col("embedding").cast("array<float>"))
    few = asked.limit(QUERY_BLOCK + 1).toArrow()
    found = _scanned(plain, few, k) if few.num_rows <= QUERY_BLOCK else _in_cells(plain, asked, k)
    best = Window.partitionBy("query_id", "index_name").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def _scanned(vectors: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    ids = asked.column(0).to_numpy()
    wanted = _matrix(asked.column(1), len(ids)) if len(ids) else np.empty((0, 1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, wanted, k)
        for batch in batches:
            if len(ids) and batch.num_rows:
                best.add(batch.column(0).to_numpy(), batch.column(1).to_pylist(), _matrix(batch.column(2), batch.num_rows))
        yield from best.batches()

    return vectors.mapInArrow(search, _HITS)


def _in_cells(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    n_cells, n_blocks = -(-vectors.count() // CELL), -(-asked.count() // QUERY_BLOCK)
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(max(1, n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    cells = vectors.withColumns({"cell": deal("chunk_id", n_cells)}).select("*", every(n_blocks).alias("block"))
    blocks = asked.withColumns({"block": deal("query_id", n_blocks)}).select("*", every(n_cells).alias("cell"))

    def product(cell: pa.Table, block: pa.Table) -> pa.Table:
        if not cell.num_rows or not block.num_rows:
            return pa.Table.from_batches([], _SCHEMA)
        best = _Best(block.column("query_id").to_numpy(), _matrix(block.column("embedding"), block.num_rows), k)
        best.add(cell.column("chunk_id").to_numpy(), cell.column("index_name").to_pylist(), _matrix(cell.column("embedding"), cell.num_rows))
        return pa.Table.from_batches(best.batches(), _SCHEMA)

    return cells.groupBy("cell", "block").cogroup(blocks.groupBy("cell", "block")).applyInArrow(product, _HITS)


_SCHEMA = pa.schema([("query_id", pa.int64()), ("index_name", pa.string()), ("chunk_id", pa.int64()), ("score", pa.float64())])


def merged_hits(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Best score of each chunk over its indexes, ranked by score; ties by chunk."""
    best = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max_by("index_name", F.struct("score", "index_name")).alias("index_name"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).cast("long"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def gated(use: Column, top: Column, threshold: Column | float) -> Column:
    """Whether retrieval stays on: wanted, and the best score reaches the threshold."""
    return use & ~F.coalesce(top < threshold, F.lit(True))


def retrieve(hits: DataFrame, thresholds: DataFrame, k: int) -> DataFrame:
    """One row for each query: winner, top score, use_rag, reason and its k best chunks.

    ``hits``: (query_id, major, major_order, chunk_id, score); ``thresholds``: (major, threshold). A
    major's gate looks at its best hit; among eligible majors the best score wins, ties by order; without
    an eligible one the best gated one is reported.
    """
    tops = hits.groupBy("query_id", "major", "major_order").agg(F.max("score").alias("top_score"))
    tops = tops.join(thresholds, "major", "left")
    tops = tops.withColumn("use_rag", gated(F.lit(True), F.col("top_score"), F.col("threshold")))
    order = F.struct(F.col("use_rag"), F.col("top_score"), -F.col("major_order"))
    winner = tops.groupBy("query_id").agg(F.max_by(F.struct("major", "top_score", "use_rag"), order).alias("w")).select("query_id", "w.*")
    own = hits.join(winner.where("use_rag").select("query_id", "major"), ["query_id", "major"])
    own = own.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("n") <= k)
    chunks = own.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), ",").alias("chunks"))
    reason = F.when(F.col("use_rag"), "ROUTED").otherwise("SCORE_BELOW_THRESHOLD")
    return winner.join(chunks, "query_id", "left").select("query_id", "major", "top_score", "use_rag", reason.alias("reason"), F.coalesce("chunks", F.lit("")).alias("chunks"))


def with_reasons(asked: DataFrame, triggered: DataFrame, answers: DataFrame) -> DataFrame:
    """Every asked query: NO_TRIGGER without a trigger, NO_RESULTS without hits, else its answer's reason."""
    on = triggered.select("query_id", F.lit(True).alias("_on")).distinct()
    out = asked.select("query_id").join(on, "query_id", "left").join(answers, "query_id", "left")
    reason = F.when(F.col("_on").isNull(), "NO_TRIGGER").when(F.col("reason").isNull(), "NO_RESULTS").otherwise(F.col("reason"))
    return out.withColumn("reason", reason).withColumn("use_rag", F.coalesce("use_rag", F.lit(False))).drop("_on")


def context_of(hits: DataFrame, budget: int = 4000) -> DataFrame:
    """(query_id, context): blocks in rank order, joined by a blank line, under a budget of characters.

    ``hits``: (query_id, rank, block). A block costs its length and 2; the last one is cut to what is left.
    """
    before = F.coalesce(F.sum(F.length("block") + 2).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = hits.withColumn("_left", F.lit(budget) - before).where("_left > 0")
    cut = left.withColumn("_part", F.expr("substring(block, 1, cast(_left as int))"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "_part"))), lambda x: x["_part"])
    return cut.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"))


def indexes_for(courses: DataFrame, routes: DataFrame, default_major: str, primary: dict[str, str]) -> DataFrame:
    """(course_id, major, indexes): stored major, else the route's, else the default; listed indexes, else
    the major's primary one, and the course's own index once."""
    valid = F.col("stored_major").isin(*primary)
    major = F.coalesce(F.when(valid, F.col("stored_major")), F.col("route_major"), F.lit(default_major))
    first = F.element_at(F.create_map(*[F.lit(x) for pair in primary.items() for x in pair]), F.col("major"))
    own = F.when(F.col("own_index").isNotNull(), F.array("own_index")).otherwise(F.array().cast("array<string>"))
    out = courses.join(routes, "course_id", "left").withColumn("major", major)
    return out.select("course_id", "major", F.array_union(F.coalesce("route_indexes", F.array(first)), own).alias("indexes"))
