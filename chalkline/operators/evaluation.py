"""Retrieval quality, threshold sweeps, model ranking and speech error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUTOFFS = (1, 3, 5)


def answer_ranks(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, query_type, n_answers, first_rank, n_found, top_score) of each query.

    ``queries``: (query_id, query_type, answers array); ``hits``: (query_id, chunk_id, score, rank).
    """
    answers = queries.select(F.col("query_id").alias("group"), F.explode("answers").alias("chunk_id"))
    return group_answer_ranks(queries.select("query_id", "query_type", F.col("query_id").alias("group")), answers, hits)


def group_answer_ranks(queries: DataFrame, answers: DataFrame, hits: DataFrame) -> DataFrame:
    """The same where queries of a group share their answers, which stay rows: ``queries`` (query_id, query_type, group),
    ``answers`` (group, chunk_id). Only a query's hits meet the answers."""
    answers = answers.select("group", "chunk_id").distinct()
    sizes = answers.groupBy("group").agg(F.count(F.lit(1)).alias("n_answers"))
    asked = queries.select("query_id", "group")
    got = hits.select("query_id", "chunk_id", "rank").join(asked, "query_id").join(answers, ["group", "chunk_id"]).groupBy("query_id").agg(
        F.min("rank").alias("first_rank"), F.count_distinct("chunk_id").alias("n_found")
    )
    top = hits.groupBy("query_id").agg(F.max("score").alias("top_score"))
    out = queries.join(sizes, "group", "left").join(got, "query_id", "left").join(top, "query_id", "left")
    none = F.lit(0).cast("long")
    return out.select("query_id", "query_type", F.coalesce("n_answers", none).alias("n_answers"), "first_rank", F.coalesce("n_found", none).alias("n_found"), "top_score")


def uplift(raw: DataFrame, normalised: DataFrame, cutoffs: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Recall of two arms, raw and normalised queries, and what the second gains; one row. Both: (query_id, n_answers, first_rank)."""
    arms = raw.select("*", F.lit("raw").alias("arm")).unionByName(normalised.select("*", F.lit("normalised").alias("arm")), allowMissingColumns=True).where("n_answers > 0")
    hit = lambda k: (F.coalesce(F.col("first_rank"), F.lit(1 << 30)) <= k).cast("double")
    of = lambda arm, k: F.avg(F.when(F.col("arm") == arm, hit(k)))
    columns = [c for k in cutoffs for c in (F.round(of("raw", k), 6).alias(f"raw_{k}"), F.round(of("normalised", k), 6).alias(f"normalised_{k}"), F.round(of("normalised", k) - of("raw", k), 6).alias(f"gain_{k}"))]
    return arms.agg(*columns)


def confusion(routed: DataFrame) -> DataFrame:
    """Router decisions against what was expected, one row. ``routed``: (expected, use_rag, gated); expected is on, off or either.

    ``accuracy`` leaves out the rows where either is right; ``gated_off`` counts triggered ones that the score gate stopped.
    """
    on, off = F.col("expected") == "on", F.col("expected") == "off"
    right = (on & F.col("use_rag")) | (off & ~F.col("use_rag"))
    return routed.agg(
        F.count_if(on & F.col("use_rag")).alias("true_on"), F.count_if(on & ~F.col("use_rag")).alias("false_off"), F.count_if(off & F.col("use_rag")).alias("false_on"),
        F.count_if(off & ~F.col("use_rag")).alias("true_off"), F.count_if(F.col("gated")).alias("gated_off"), F.round(F.avg(F.when(on | off, right.cast("double"))), 6).alias("accuracy"),
    )


def metrics(ranks: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Recall at each cutoff, MRR and full recall, over all positives and for each query type."""
    at = [F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in cutoffs]
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr")
    full = F.round(F.avg((F.col("n_found") == F.col("n_answers")).cast("double")), 6).alias("full_recall")
    out = ranks.where("n_answers > 0").groupingSets([["query_type"], []], "query_type").agg(
        F.coalesce(F.when(F.grouping("query_type") == 1, "ALL"), F.first("query_type")).alias("group"), F.count(F.lit(1)).alias("n"), *at, mrr, full
    )
    return out.where("n > 0").drop("query_type")


def relaxed_answers(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Answers widened to all chunks of their (source, chapter); a chunk without a chapter stays alone."""
    asked = queries.select("query_id", F.explode("answers").alias("chunk_id")).join(chunks, "chunk_id", "left")
    inside = chunks.where("chapter is not null").select(F.col("chunk_id").alias("sibling"), F.col("source").alias("_s"), F.col("chapter").alias("_c"))
    wide = asked.join(inside, (asked.source == inside["_s"]) & (asked.chapter == inside["_c"]), "left")
    return wide.select("query_id", F.coalesce("sibling", "chunk_id").alias("chunk_id")).distinct()


def threshold_sweep(ranks: DataFrame, low: float = 0.30, high: float = 0.70, step: float = 0.05) -> DataFrame:
    """Share of negatives below, and of positives at or above, each threshold."""
    n = round((high - low) / step) + 1
    grid = F.explode(F.array(*[F.lit(round(low + step * i, 2)) for i in range(n)])).alias("threshold")
    negative = F.col("n_answers") == 0
    swept = ranks.select("n_answers", "top_score", grid)
    return swept.groupBy("threshold").agg(
        F.round(F.avg(F.when(negative, (F.col("top_score") < F.col("threshold")).cast("double"))), 6).alias("blocked"),
        F.round(F.avg(F.when(~negative, (F.col("top_score") >= F.col("threshold")).cast("double"))), 6).alias("passed"),
    )


def score_split(ranks: DataFrame) -> DataFrame:
    """Mean and population deviation of the top score of positives and negatives."""
    kind = F.when(F.col("n_answers") > 0, "positive").otherwise("negative").alias("kind")
    return ranks.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("top_score"), 6).alias("mean"), F.round(F.stddev_pop("top_score"), 6).alias("deviation"))


def best_model(models: DataFrame, group: str, model: str, first: str, second: str) -> DataFrame:
    """The best model of each group by two measures, and its lead over the next."""
    order = Window.partitionBy(group).orderBy(F.desc(first), F.desc(second), model)
    ranked = models.withColumns({"_n": F.row_number().over(order), "_next": F.lead(first).over(order), "_second": F.lead(model).over(order)})
    return ranked.where("_n = 1").select(group, model, first, F.col("_second").alias("runner_up"), F.round(F.col(first) - F.col("_next"), 6).alias("lead"))


def kept_answers(answers: Column, members: Column) -> tuple[Column, Column]:
    """Answers that an index holds, and those it lacks."""
    return F.array_intersect(answers, members), F.array_except(answers, members)


def error_rate(distance: Column, reference_length: Column, hypothesis_length: Column) -> Column:
    """Edits for each unit of reference; an empty reference gives 0 for an empty hypothesis, else 1."""
    empty = F.when(hypothesis_length == 0, 0.0).otherwise(1.0)
    return F.when(reference_length == 0, empty).otherwise(distance / reference_length)


def scored_runs(samples: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """``samples`` (key, reference) with the hypothesis of ``runs`` (key, hypothesis): a run that failed, or gave nothing,
    counts as the empty text."""
    texts = samples.withColumn("reference", F.coalesce("reference", F.lit("")))
    return texts.join(runs, key, "left").withColumn("hypothesis", F.coalesce("hypothesis", F.lit("")))


def weighted_error(rate: Column, length: Column) -> Column:
    """Error rate over all units of several references; 0 without any."""
    return F.coalesce(F.sum(rate * length) / F.nullif(F.sum(length), F.lit(0)), F.lit(0.0))


def pseudo_confidence(logprobs: Column) -> Column:
    """exp of the mean log probability within 0..1; null for none."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(F.size(logprobs) > 0, total / F.size(logprobs))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(mean))) * F.when(mean.isNotNull(), 1.0)


def mean_confidence(logprob: Column) -> Column:
    """The same as an aggregate over rows."""
    mean = F.avg(logprob)
    return F.when(mean.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(mean))))


@F.arrow_udf(T.LongType())
def word_distance(reference, heard):
    """Edits between two lists of words."""
    import numpy as np
    import pyarrow as pa

    def edits(a: list[str], b: list[str]) -> int:
        known: dict[str, int] = {}
        x = np.array([known.setdefault(w, len(known)) for w in a], np.int64)
        y = np.array([known.setdefault(w, len(known)) for w in b], np.int64)
        row = np.arange(len(y) + 1)
        for i, w in enumerate(x, 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (y != w))
            new = np.concatenate([[i], best])
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))  # insertions run on
        return int(row[-1])

    pairs = zip(reference.to_pylist(), heard.to_pylist())
    return pa.array([None if a is None or b is None else edits(a, b) for a, b in pairs], pa.int64())


def word_error_rate(reference: Column, heard: Column) -> Column:
    """Edits for each reference word, of two word lists."""
    return error_rate(word_distance(reference, heard), F.size(reference), F.size(heard))
