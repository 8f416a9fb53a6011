"""The key links of a database as edge and node tables, and time-respecting sampling on them."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograin.functions.draws import draw
from chronograin.functions.permute import positions_drawn, round_keys
from chronograin.model import Database, Table, TaskKind
from chronograin.operators.columns import column_stats, infer_kinds, without_keys
from chronograin.operators.integrity import check_dense
from chronograin.operators.running import dense_row_ids, running_totals
from chronograin.operators.windows import union_all
from chronograin.session import cut_lineage

ROW_ID = "row_id"
EDGE_COLUMNS = ("edge_type", "src_table", "dst_table", "src_id", "dst_id", "src_time", "dst_time")


def unix_time(table: Table) -> Column:
    """Row time in seconds; NULL for a table without time, whose rows always exist."""
    if table.time_col is None:
        return F.lit(None).cast("bigint")
    return F.unix_seconds(F.col(table.time_col).cast("timestamp"))


def with_row_ids(db: Database, keys_only: bool = False) -> Database:
    """Give every table without primary key dense row numbers; others keep their key as row id.

    ``keys_only`` leaves numbered tables with their foreign keys and time, which is all that edges need: only
    these are written, though all columns decide the order.
    """

    def numbered(table: Table) -> Table:
        if table.pkey is not None:
            return table.with_df(table.df.withColumn(ROW_ID, F.col(table.pkey)))
        order = [*([F.col(table.time_col).asc_nulls_last()] if table.time_col else []), *table.fkeys]
        rest = [c for c in table.df.columns if c != table.time_col and c not in table.fkeys]
        plain = [c for c in rest if not table.df.schema[c].dataType.typeName().startswith(("map", "variant"))]
        kept = list(dict.fromkeys([*([table.time_col] if table.time_col else []), *table.fkeys])) if keys_only else None
        return table.with_df(dense_row_ids(table.df, [*order, *plain], ROW_ID, kept))

    return db.map(numbered)


def _edge(label: str, src: tuple[str, str, str], dst: tuple[str, str, str]) -> Column:
    return F.struct(
        F.lit(label).alias("edge_type"), F.lit(src[2]).alias("src_table"), F.lit(dst[2]).alias("dst_table"),
        F.col(src[0]).cast("bigint").alias("src_id"), F.col(dst[0]).cast("bigint").alias("dst_id"),
        F.col(src[1]).alias("src_time"), F.col(dst[1]).alias("dst_time"),
    )


def edge_types(db: Database) -> list[tuple[str, str, str]]:
    """(edge_type, src_table, dst_table) of a schema; read from its keys, not from the edges."""
    out = []
    for name, table in db.tables.items():
        for fkey, target in table.fkeys.items():
            out += [(f"f2p_{fkey}", name, target), (f"rev_f2p_{fkey}", target, name)]
    return out


def fk_edges(db: Database, into: Collection[str] | None = None) -> DataFrame:
    """One row per link and direction, for a database ``with_row_ids``.

    A NULL or unknown key gives no edge. The reverse of ``f2p_<key>`` is ``rev_f2p_<key>``.
    ``into`` keeps the edges that lead to these tables; links it rules out are not read.
    """
    out = []
    for name, table in db.tables.items():
        for fkey, target in table.fkeys.items():
            fact, entity = ("_f", "_ft", name), ("_p", "_pt", target)
            wanted = [(f"f2p_{fkey}", fact, entity), (f"rev_f2p_{fkey}", entity, fact)]
            wanted = [w for w in wanted if into is None or w[2][2] in into]
            if not wanted:
                continue
            end = db[target]
            known = end.df.select(F.col(end.pkey).alias("_p"), unix_time(end).alias("_pt"))
            rows = table.df.where(F.col(fkey).isNotNull()).select(
                F.col(ROW_ID).alias("_f"), F.col(fkey).alias("_k"), unix_time(table).alias("_ft")
            )
            met = rows.join(known, F.col("_k") == F.col("_p"))
            out.append(met.select(F.inline(F.array(*[_edge(*w) for w in wanted]))))
    return union_all(out)


def sorted_edges(edges: DataFrame) -> DataFrame:
    """Edges laid out by type, source and destination, for writing."""
    by = ["edge_type", "src_table", "dst_table", "src_id", "dst_id"]
    return edges.repartitionByRange(*by).sortWithinPartitions(*by)


def node_table(table: Table) -> DataFrame:
    """(row_id, unix_time, features..); a constant where a table has only keys."""
    cols = [c for c in table.feature_columns if c not in (ROW_ID, table.time_col)]
    features = [F.col(c) for c in cols] or [F.lit(1.0).alias("const")]
    return table.df.select(ROW_ID, unix_time(table).alias("unix_time"), *features)


def node_stats(table: Table) -> DataFrame:
    """Statistics of the feature columns by kind, for encoders."""
    return column_stats(table.df, without_keys(infer_kinds(table), table))


def checked(db: Database) -> Database:
    """Keys must be numbered 0 .. n-1 where matrices are to be built from them."""
    for name, table in db.tables.items():
        check_dense(name, table)
    return db


# --- training inputs ------------------------------------------------------------------------------


def node_train_input(labels: DataFrame, entity: str, target: str | None, kind: TaskKind, time_col: str = "timestamp") -> DataFrame:
    """(input_id, node, unix_time, target): the target typed by the kind of task, if present."""
    order = [time_col, entity]
    rows = dense_row_ids(labels, order, "input_id")
    cols = ["input_id", F.col(entity).cast("bigint").alias("node"), F.unix_seconds(F.col(time_col).cast("timestamp")).alias("unix_time")]
    if target is not None and target in labels.columns:
        kinds = {TaskKind.MULTICLASS: "bigint", TaskKind.MULTILABEL: "array<int>"}
        cols.append(F.col(target).cast(kinds.get(kind, "double")).alias("target"))
    return rows.select(*cols)


def link_train_input(pairs: DataFrame, src: str, dst: str, time_col: str = "timestamp") -> DataFrame:
    """(input_id, src, dst, unix_time): one row per true pair; rows of a list share the input id."""
    lists = dense_row_ids(pairs.select(time_col, src).distinct(), [time_col, src], "input_id")
    return pairs.join(lists, [time_col, src]).select(
        "input_id", F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst"),
        F.unix_seconds(F.col(time_col).cast("timestamp")).alias("unix_time"),
    )


def attach_target(batch: DataFrame, inputs: DataFrame) -> DataFrame:
    """Labels of sampled rows by their input id."""
    return batch.join(inputs.select("input_id", "target"), "input_id")


def truth_of(links: DataFrame, inputs: DataFrame) -> DataFrame:
    """True destinations of some input rows."""
    return links.join(inputs.select("input_id").distinct(), "input_id", "left_semi").select("input_id", "dst")


def link_triples(links: DataFrame, n_dst: int, seed: int) -> DataFrame:
    """Per input row one random true destination and one uniform random one, both by hash."""
    pick = F.struct(draw(seed, "input_id", "dst"), "dst")
    return links.groupBy("input_id", "src", "unix_time").agg(F.min_by("dst", pick).alias("pos_dst")).withColumn(
        "neg_dst", F.pmod(draw(seed + 1, "input_id", "src"), F.lit(n_dst))
    )


def same_time_batches(inputs: DataFrame, batch_size: int, seed: int) -> DataFrame:
    """Random full batches of rows with the same time; the rest of each time is left out.

    Rows of a time are numbered along a hash order over range partitions, so a time may hold
    any share of the rows.
    """
    rows = running_totals(
        inputs, ["unix_time"], [draw(seed, "input_id"), "input_id"], {"_nr": F.lit(1).cast("bigint")}
    )
    sizes = inputs.groupBy("unix_time").agg(F.count(F.lit(1)).alias("_n"))
    batch = F.floor((F.col("_nr") - 1) / F.lit(batch_size))
    full = F.floor(F.col("_n") / F.lit(batch_size))
    return (
        rows.join(sizes, "unix_time")
        .withColumn("batch", batch)
        .where(F.col("batch") < full)
        .select(*inputs.columns, "batch")
    )


# --- sampling -----------------------------------------------------------------------------------------

NEVER_BEFORE = -(1 << 62)
# Asks are spread over anchors, types and positions by explode, which Spark's size estimates leave out: without this hint
# it would take very many of them for few and send them all through the driver.
SHUFFLED = "merge"
# an edge type and the node its edges lead to
INTO = ("edge_type", "src_table", "dst_table", "dst_id")


def _visible(edges: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number the edges into each node by time, and count per ask the edges it may see.

    Edges and asks share one range-sorted pass: an ask sees the edges sorted before it. So
    neither a hub with very many edges nor one with very many asks meets in one task, and no
    ask is ever joined with all edges of its node.
    """
    keys = [*INTO]
    wanted = edges.join(asks.select(*keys).distinct().hint(SHUFFLED), keys, "left_semi")
    edge_rows = wanted.select(
        *keys, F.coalesce("src_time", F.lit(NEVER_BEFORE)).alias("_when"), F.lit(0).alias("_ask"),
        "src_id", "src_time", F.lit(None).cast("bigint").alias("seed_id"), F.lit(None).cast("bigint").alias("seed_time"),
    )
    ask_rows = asks.select(
        *keys, F.col("seed_time").alias("_when"), F.lit(1).alias("_ask"),
        F.lit(None).cast("bigint").alias("src_id"), F.lit(None).cast("bigint").alias("src_time"), "seed_id", "seed_time",
    )
    ranked = running_totals(
        edge_rows.unionByName(ask_rows), keys, ["_when", "_ask", "src_id", "seed_id"], {"_seen": 1 - F.col("_ask")}
    )
    numbered = ranked.where(F.col("_ask") == 0).select(*keys, "src_id", "src_time", F.col("_seen").alias("_pos"))
    counted = ranked.where(F.col("_ask") == 1).select(*keys, "seed_id", "seed_time", F.col("_seen").cast("bigint").alias("_n"))
    return numbered, counted.where(F.col("_n") > 0)


# what a draw of neighbours depends on, apart from the seed
ASK = ("edge_type", "src_table", "dst_id", "seed_id", "seed_time")


def _positions(n: Column, k: int, strategy: str, seed: int) -> Column:
    """At most k of the positions 1 .. n: the last ones, or a uniform sample, in which every set of k is as likely
    as any other.
    """
    if strategy == "last":
        return F.sequence(F.greatest(n - (k - 1), F.lit(1).cast("bigint")), n)
    if strategy != "uniform":
        raise ValueError(f"unknown strategy {strategy}")
    return positions_drawn(n, k, round_keys(seed, *ASK))


def temporal_neighbors(
    edges: DataFrame, asks: DataFrame, k: int, strategy: str = "uniform", seed: int = 0
) -> DataFrame:
    """(seed_id, seed_time, edge_type, src_table, dst_table, dst_id, src_id, src_time): at most k
    neighbours per ask and edge type, none later than the seed time; k = -1 keeps all.

    ``asks`` has (seed_id, seed_time, edge_type, src_table, dst_table, dst_id). Positions are drawn first
    and then looked up by (node, position), a unique key that also spreads hubs.
    """
    keys = [*INTO]
    if k < 0:
        met = edges.join(asks.hint(SHUFFLED), keys)
        return met.where(F.col("src_time").isNull() | (F.col("src_time") <= F.col("seed_time"))).select(
            "seed_id", "seed_time", *keys, "src_id", "src_time"
        )
    numbered, counted = _visible(edges, asks)
    drawn = counted.select(*keys, "seed_id", "seed_time", F.explode(_positions(F.col("_n"), k, strategy, seed)).alias("_pos"))
    return drawn.join(numbered.hint(SHUFFLED), [*keys, "_pos"]).select("seed_id", "seed_time", *keys, "src_id", "src_time")


def _asks(nodes: DataFrame, types: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per node and edge type that leads to its table."""
    known = F.array(
        *[F.struct(F.lit(e).alias("edge_type"), F.lit(s).alias("src_table"), F.lit(d).alias("to")) for e, s, d in types]
    )
    into = nodes.select("*", F.inline(known)).where(F.col("to") == F.col("dst_table"))
    return into.drop("to")


# edges into one node that may lie in one row, which is read once for each ask of the node
NEAR_EDGES = 256


def _numbered(types: Sequence[tuple[str, str, str]]) -> Column:
    """The place of an edge's type among ``types``."""
    named = ("edge_type", "src_table", "dst_table")
    places = [F.when(F.struct(*named) == F.struct(*map(F.lit, t)), F.lit(i)) for i, t in enumerate(types)]
    return F.coalesce(*places).cast("smallint")


def _near_neighbors(
    edges: DataFrame, nodes: DataFrame, types: Sequence[tuple[str, str, str]], k: int, strategy: str, seed: int
) -> DataFrame:
    """Like ``temporal_neighbors`` for all ``types`` into ``nodes`` (seed_id, seed_time, dst_table, dst_id), of few edges each.

    The edges into a node are one sorted row, so what an ask may see and what is drawn of it are parts of that row: an ask is
    shuffled once, whatever the number of types, and nothing after it is. Rows are dealt anew before they meet the asks, so that
    a node of very many asks can be split.
    """
    at = ["dst_table", "dst_id"]
    slim = edges.select(*at, _numbered(types).alias("_type"), "src_id", "src_time")
    entry = F.struct("_type", F.coalesce("src_time", F.lit(NEVER_BEFORE)).alias("_when"), "src_id", "src_time")
    rows = slim.repartition(*reversed(at)).groupBy(*at).agg(F.sort_array(F.collect_list(entry)).alias("_edges"))
    met = nodes.join(rows.hint(SHUFFLED), at)
    known = F.array(*[
        F.struct(F.lit(i).cast("smallint").alias("_type"), F.lit(e).alias("edge_type"), F.lit(s).alias("src_table"), F.lit(d).alias("_to"))
        for i, (e, s, d) in enumerate(types)
    ])
    asked = met.select("*", F.inline(known)).where(F.col("_to") == F.col("dst_table"))
    visible = F.filter("_edges", lambda e: (e["_type"] == F.col("_type")) & (e["_when"] <= F.col("seed_time")))
    seen = asked.select("seed_id", "seed_time", *INTO, visible.alias("_seen")).where(F.size("_seen") > 0)
    drawn = seen.withColumn("_drawn", _positions(F.size("_seen").cast("bigint"), k, strategy, seed))
    found = F.transform("_drawn", lambda p: F.get("_seen", (p - 1).cast("int")))
    return drawn.select("seed_id", "seed_time", *INTO, F.explode(found).alias("_edge")).select(
        "seed_id", "seed_time", *INTO, "_edge.src_id", "_edge.src_time"
    )


def _node_neighbors(
    edges: DataFrame, nodes: DataFrame, types: Sequence[tuple[str, str, str]], k: int, strategy: str, seed: int
) -> DataFrame:
    """At most k neighbours of each of ``nodes`` and of each of ``types`` that leads to it; k = -1 keeps all."""
    if k < 0:
        return temporal_neighbors(edges, _asks(nodes, types), k, strategy, seed)
    at = ["dst_table", "dst_id"]
    many = edges.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > NEAR_EDGES)
    hubs = cut_lineage(many.select(*at))
    if hubs.isEmpty():
        return _near_neighbors(edges, nodes, types, k, strategy, seed)
    near = [df.join(hubs, at, "left_anti") for df in (edges, nodes)]
    far = [df.join(hubs, at, "left_semi") for df in (edges, nodes)]
    return _near_neighbors(*near, types, k, strategy, seed).unionByName(
        temporal_neighbors(far[0], _asks(far[1], types), k, strategy, seed)
    )


def sample_subgraphs(
    db: Database,
    seed_table: str,
    seeds: DataFrame,
    fanout: Sequence[int],
    strategy: str = "uniform",
    seed: int = 0,
) -> DataFrame:
    """Sampled edges of every seed, hop by hop: (seed_id, seed_time, hop, edge_type, .., src_time).

    ``seeds`` has (seed_id, seed_time, node_id), nodes of ``seed_table``. Subgraphs of different
    seeds are kept apart. A node is expanded once per seed, in the hop that first reaches it. Each
    hop's sample is cut to ``fanout`` per edge type before the next begins, and reads only links
    that lead to the tables it has reached.
    """
    types, reached_tables = edge_types(db), {seed_table}
    frontier = seeds.select("seed_id", "seed_time", F.lit(seed_table).alias("dst_table"), F.col("node_id").alias("dst_id"))
    visited, hops = frontier, []
    for hop, k in enumerate(fanout, 1):
        found = _node_neighbors(fk_edges(db, reached_tables), frontier, types, k, strategy, seed + hop)
        hops.append(found.withColumn("hop", F.lit(hop)))
        if hop < len(fanout):
            reached = found.select("seed_id", "seed_time", F.col("src_table").alias("dst_table"), F.col("src_id").alias("dst_id"))
            by = ["seed_id", "dst_table", "dst_id"]
            # dealt by what they are compared along, so that they are shuffled once for both
            frontier = reached.repartition(*by).distinct().join(visited.hint(SHUFFLED), by, "left_anti")
            visited = visited.unionByName(frontier)
            reached_tables = {s for _, s, d in types if d in reached_tables}
    return union_all(hops)


def halving(first: int, hops: int) -> list[int]:
    """Fan-out that halves with each hop."""
    return [max(1, first // 2**h) for h in range(hops)]


def neighbor_aggregate(
    edges: DataFrame, features: Mapping[str, DataFrame], cols: Sequence[str], how: str = "mean"
) -> DataFrame:
    """Per destination node: mean or sum of its neighbours' features per edge type, added over types.

    ``features`` maps a table to (row_id, cols..). The mean needs only partial sums, so hubs
    are combined before the shuffle.
    """
    combine = {"mean": F.avg, "sum": F.sum}[how]
    parts = []
    for table, frame in features.items():
        own = edges.where(F.col("src_table") == table)
        met = own.join(frame.select(F.col(ROW_ID).alias("src_id"), *cols), "src_id")
        parts.append(met.groupBy("edge_type", "dst_table", "dst_id").agg(*[combine(c).alias(c) for c in cols]))
    return union_all(parts).groupBy("dst_table", "dst_id").agg(*[F.sum(c).alias(c) for c in cols])

