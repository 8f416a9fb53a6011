"""Pruned top-k by dot product against the plain matrix product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronograin.operators import links, scoring

SCHEMA = "id bigint, v array<double>"


def frame(spark, rows, ids=None):
    ids = range(len(rows)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, rows, strict=True)], SCHEMA)


def brute(queries, items, k):
    scores = queries @ items.T
    order = np.lexsort((np.broadcast_to(np.arange(len(items)), scores.shape), -scores), axis=1)[:, :k]
    return {(q, int(i), rank) for q in range(len(queries)) for rank, i in enumerate(order[q], 1)}


def rows_of(found):
    return {(r.query_id, r.item_id, r["rank"]) for r in found.collect()}


def clustered(rng, n, centres, width=16):
    """Directions around a few centres, with norms between 1 and 3."""
    rows = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, width)) * 0.05
    return rows / np.linalg.norm(rows, axis=1)[:, None] * rng.uniform(1, 3, n)[:, None]


def test_few_pairs_of_blocks_are_visited_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    items, queries = clustered(rng, 3000, centres), clustered(rng, 400, centres)
    index = scoring.build_index(frame(spark, items), block_rows=32)
    best, visited = scoring.search(frame(spark, queries), index, 5, query_rows=16)
    assert rows_of(best) == brute(queries, items, 5)
    pairs = index.blocks.count() * scoring.pack(frame(spark, queries), index.centres, 16).count()
    assert visited.count() == visited.distinct().count() < pairs / 2
    assert index.limits.agg(F.sum("n"), F.max("n")).first() == (3000, 32)


@pytest.mark.parametrize("waves", [(), (1,), (2, 3)])
def test_equal_scores_go_by_id(spark, waves):
    rng = np.random.default_rng(2)
    # whole numbers: equal scores are exactly equal; a third of all items are one vector, some are zero
    items = rng.integers(-2, 3, size=(300, 4)).astype(float)
    items[::3] = [1, 1, 0, 2]
    items[1::10] = 0
    queries = np.vstack([rng.integers(-2, 3, size=(40, 4)), np.zeros((2, 4)), -np.ones((1, 4))])
    index = scoring.build_index(frame(spark, items), scoring.find_centres(frame(spark, items), 7, steps=2), 16)
    best, _ = scoring.search(frame(spark, queries), index, 6, 8, waves)
    assert rows_of(best) == brute(queries, items, 6)


def test_fewer_items_than_asked_for(spark):
    items, queries = np.eye(3), np.array([[1.0, 2.0, 3.0], [0.0, 0.0, 0.0]])
    got = links.score_top_k(frame(spark, queries), frame(spark, items), 10)
    assert rows_of(got) == brute(queries, items, 10) and got.columns == ["query_id", "item_id", "score", "rank"]
    assert links.score_top_k(frame(spark, queries[:0]), frame(spark, items), 10).count() == 0
    assert links.score_top_k(frame(spark, queries), frame(spark, items[:0]), 10).count() == 0


def test_missing_and_unequal_vectors(spark):
    items = frame(spark, np.eye(3)).unionByName(spark.createDataFrame([(None, [1.0, 1.0, 1.0]), (7, None)], SCHEMA))
    assert rows_of(links.score_top_k(items, items, 1)) == {(i, i, 1) for i in range(3)}
    with pytest.raises(Exception, match="vectors of 3 numbers expected"):
        links.score_top_k(frame(spark, np.eye(3)).unionByName(spark.createDataFrame([(9, [1.0])], SCHEMA)), frame(spark, np.eye(3)), 1).collect()
    with pytest.raises(ValueError, match="positive"):
        links.score_top_k(items, items, 0)


def test_bounds_hold_for_every_block(spark):
    rng = np.random.default_rng(3)
    items = rng.normal(size=(200, 8)) * rng.uniform(0, 5, (200, 1))
    index = scoring.build_index(frame(spark, items), block_rows=10)
    for r in index.blocks.collect():
        rows = np.frombuffer(r.payload).reshape(r.n, 8)
        assert np.array_equal(rows, items[r.ids])
        norms, far = np.linalg.norm(rows, axis=1), np.linalg.norm(rows - index.centres[r.cluster], axis=1)
        assert norms.max() == pytest.approx(r.largest) and far.max() == pytest.approx(r.radius)
        assert (np.diff(norms) <= 1e-12).all()
    queries = frame(spark, rng.normal(size=(20, 8)))
    nothing = scoring.reachable(queries, index, queries.select(F.col("id").alias("query_id"), F.lit(1e9).alias("mark")))
    everything = scoring.reachable(queries, index, queries.select(F.col("id").alias("query_id"), F.lit(-1e9).alias("mark")))
    assert {r.n_items for r in nothing.collect()} == {0} and {r.n_items for r in everything.collect()} == {200}


def test_vectors_are_sent_once_for_a_sheet_not_once_for_a_pair(spark):
    """Where nothing can be pruned every pair of blocks meets; copies of blocks grow with the sheets only."""
    rows = [[(i * 7 + j * 3) % 11 for j in range(4)] for i in range(320)]
    index = scoring.build_index(frame(spark, rows), block_rows=8)
    packed = scoring.pack(frame(spark, rows), index.centres, 8)
    asks = packed.select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("payload").alias("q_payload"),
        F.lit(None).cast("array<struct<query_id:bigint,score:double>>").alias("marks"),
    )
    pairs = asks.select("q_block").crossJoin(index.blocks.select("block"))
    sent = scoring._cells(pairs, asks, index, (2, 3))
    n_q, n_i = packed.count(), index.blocks.count()
    assert sent.count() <= 3 * n_q + 2 * n_i < pairs.count()
    assert sent.selectExpr("sum(size(wanted))").first()[0] == n_q * n_i == pairs.count()


def test_sheets_fit_memory_and_do_not_grow_before():
    assert scoring._sheets(100, 50_000, 64, 12) == scoring._sheets(700, 350_000, 64, 12) == 6
    assert scoring._sheets(2000, 1_000_000, 64, 12) == scoring._sheets(9000, 1_000_000, 64, 12) == 16
    assert scoring._sheets(3, 1500, 64, 12) == 3 and scoring._sheets(0, 0, 64, 12) == 1


def test_items_pass_so_their_sheets_do_not_grow_with_those_of_the_queries():
    """Copies of vectors that a round may shuffle: every query once for a sheet of items, every item once for one of queries."""

    def copies(n):
        side = (-(-n // 512), n), (-(-n // 2048), n)
        n_q, n_i = scoring._both_sheets(*side, 64, 12)
        assert n_q * n_i >= 3 * 12 and n * 64 * 8 <= n_q * scoring.SHEET_BYTES and n * 64 * 8 <= n_i * scoring.PASSED_BYTES
        return n * (n_q + n_i)

    assert copies(615_000) <= 7.2 * copies(102_500)
    # few queries: they are copied to many sheets, so that items move once
    assert scoring._both_sheets((1, 100), (500, 1_000_000), 64, 12) == (1, 36)
    assert scoring._both_sheets((0, 0), (0, 0), 64, 12) == (1, 1)
