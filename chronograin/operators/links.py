"""Recommendation lists: popularity, past visits, candidates, ranking.

Everything works on pairs (row per item). Counts are partially aggregated, and top-k filters
reach the map side (window group limit), so a source with very many items sends only k per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronograin.functions.draws import draw
from chronograin.operators.joins import with_constants

PAD = -1


def pair_counts(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """Past visits per (src, dst)."""
    return pairs.groupBy(src, dst).agg(F.count(F.lit(1)).alias("num_past_visit"))


def popularity(pairs: DataFrame, dst: str) -> DataFrame:
    """Visits per dst and their share of the largest count."""
    counts = pairs.groupBy(dst).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("_top"))
    return with_constants(counts, top).select(
        dst, "n", (F.col("n") / F.col("_top")).alias("global_popularity_fraction")
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def past_visits(pairs: DataFrame, src: str, dst: str, k: int) -> DataFrame:
    """(src, dst, rank): the k most frequent dst of each src, ties by id."""
    counted = pair_counts(pairs, src, dst)
    best = top_k(counted, [src], [F.desc("num_past_visit"), F.asc(dst)], k)
    return best.select(src, dst, "rank")


def most_popular(pairs: DataFrame, dst: str, k: int) -> DataFrame:
    """(dst, rank): the k most frequent dst over all pairs, ties by id; at most k rows."""
    counts = pairs.groupBy(dst).agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), F.asc(dst)).limit(k)
    # k rows: a single-task window over them is bounded
    return top_k(best.withColumn("_all", F.lit(0)), ["_all"], [F.desc("n"), F.asc(dst)], k).select(dst, "rank")


def padded_lists(ranked: DataFrame, keys: Sequence[str], dst: str, k: int, name: str) -> DataFrame:
    """Ranked items (at most k per key) as arrays of exactly k, filled with -1."""
    items = F.array_sort(F.collect_list(F.struct("rank", dst)))
    filled = F.concat(F.transform(items, lambda x: x[dst]), F.array_repeat(F.lit(PAD).cast("bigint"), k))
    return ranked.groupBy(*keys).agg(F.slice(filled, 1, k).alias(name))


def predict_past_visits(rows: DataFrame, pairs: DataFrame, src: str, dst: str, k: int) -> DataFrame:
    """``rows`` with a list of k predictions; -1 throughout for a src without history."""
    lists = padded_lists(past_visits(pairs, src, dst, k), [src], dst, k, "pred")
    empty = F.array_repeat(F.lit(PAD).cast("bigint"), k)
    return rows.join(lists, src, "left").withColumn("pred", F.coalesce("pred", empty))


def predict_most_popular(rows: DataFrame, pairs: DataFrame, dst: str, k: int) -> DataFrame:
    """``rows`` with the same k globally popular predictions each (one broadcast row)."""
    best = most_popular(pairs, dst, k).withColumn("_all", F.lit(0))
    one = padded_lists(best, ["_all"], dst, k, "pred").drop("_all")
    return with_constants(rows, one)


def candidates(rows: DataFrame, pairs: DataFrame, src: str, dst: str, k: int) -> DataFrame:
    """(rows.., dst, place): past visits (at most k) and popular items (at most 2k) in turn, 2k in all.

    Item i of the first list stands at 2i, item i of the second at 2i + 1. Where one list ends
    the other runs on, which is the order of (i, list). Repeats between the lists stay, as
    in the lists themselves.
    """
    limit = 2 * k
    own = padded_lists(past_visits(pairs, src, dst, k), [src], dst, k, "_own")
    own = own.withColumn("_own", F.filter("_own", lambda x: x != PAD))
    top = most_popular(pairs, dst, limit).withColumn("_all", F.lit(0))
    top = padded_lists(top, ["_all"], dst, limit, "_top").drop("_all")
    top = top.withColumn("_top", F.filter("_top", lambda x: x != PAD))
    none = F.array().cast("array<bigint>")
    both = with_constants(rows.join(own, src, "left"), top)
    # arrays of at most k and 2k items
    zipped = F.transform(
        F.arrays_zip(F.coalesce("_own", none).alias("a"), F.col("_top").alias("b")), lambda p: F.array(p["a"], p["b"])
    )
    mixed = F.slice(F.array_compact(F.flatten(zipped)), 1, limit)
    return both.select(*rows.columns, F.posexplode(mixed).alias("place", dst))


def past_features(pairs_to_score: DataFrame, history: DataFrame, src: str, dst: str) -> DataFrame:
    """Add past visit count of the pair and popularity of the dst, 0 where unseen."""
    seen = pair_counts(history, src, dst)
    share = popularity(history, dst).drop("n")
    return (
        pairs_to_score.join(seen, [src, dst], "left")
        .join(share, dst, "left")
        .fillna(0, subset=["num_past_visit"])
        .fillna(0.0, subset=["global_popularity_fraction"])
    )


def rank_predictions(scored: DataFrame, keys: Sequence[str], dst: str, score: str, k: int) -> DataFrame:
    """Lists of the k best dst per key by score, ties by id, filled with -1."""
    best = top_k(scored, keys, [F.desc(score), F.asc(dst)], k)
    return padded_lists(best, keys, dst, k, "pred")


def negative_pairs(
    pairs: DataFrame, dst: str, n_ids: int, seed: int, avoid_known: bool = False
) -> DataFrame:
    """One random dst per pair, by hash; ids must be numbered 0 .. n_ids-1 (see ``reindex``).

    As a uniform draw may hit a known pair, ``avoid_known`` drops such draws.
    """
    drawn = F.pmod(draw(seed, *pairs.columns), F.lit(n_ids))
    out = pairs.withColumn(dst, drawn.cast(pairs.schema[dst].dataType))
    return out.join(pairs, pairs.columns, "left_anti") if avoid_known else out


def labelled_pairs(pairs: DataFrame, negatives: DataFrame, name: str = "label") -> DataFrame:
    return pairs.withColumn(name, F.lit(1)).unionByName(negatives.withColumn(name, F.lit(0)))


def is_linked(pairs: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether each pair occurs in the truth."""
    known = truth.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return pairs.join(known, list(keys), "left").withColumn("is_linked", F.col("_hit").isNotNull()).drop("_hit")


def score_top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k items with the largest dot product for each query: (query_id, item_id, score, rank).

    Both inputs are (id, vector). Vectors are clustered into blocks, and bounds on what a block can score
    decide which pairs of blocks meet, as a matrix product inside a task. Memory per task is one block of each side.
    """
    from chronograin.operators.scoring import blockwise_top_k

    return blockwise_top_k(queries, items, k)
