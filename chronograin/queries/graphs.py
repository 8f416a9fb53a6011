"""Edges, node tables, sampling and training inputs over the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronograin.functions.draws import draw_sql
from chronograin.functions.permute import half_bits_sql, permuted_sql, round_keys_sql
from chronograin.functions.text import hash_embedding, reduced_embedding, weighted_embedding, weighted_embedding_sql
from chronograin.grid import Grid
from chronograin.model import Database, Table, TaskKind
from chronograin.operators import adjacency, columns, graph, links, windows
from chronograin.plans import boosted
from chronograin.plans.catalog import get_task
from chronograin.queries import Book, read
from chronograin.queries.databases import DATASETS
from chronograin.queries.labels import BOOK as LABELS
from chronograin.session import cut_lineage, work_path

BOOK = Book()

GRID = Grid("train", datetime(1997, 1, 1), timedelta(days=91), 12)


def _db(spark, sf_dir, *names: str, keys_only: bool = False) -> Database:
    """Customers, parts and orders with their lines (or some of these tables, whole): three links."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    lines = read(spark, sf_dir, "lineitem").select(
        "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    tables = {
        "customer": Table(read(spark, sf_dir, "customer"), "c_custkey"),
        "part": Table(read(spark, sf_dir, "part"), "p_partkey"),
        "orders": Table(orders, "o_orderkey", "o_orderdate", {"o_custkey": "customer"}),
        "lineitem": Table(lines, None, "l_shipdate", {"l_orderkey": "orders", "l_partkey": "part"}),
    }
    return graph.with_row_ids(Database({n: t for n, t in tables.items() if not names or n in names}), keys_only)


_LINE = """line AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS id,
  CAST(floor(epoch(l_shipdate)) AS BIGINT) AS t FROM lineitem),
ord AS (SELECT *, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t FROM orders)"""

_EDGES = """edges AS (
  SELECT 'f2p_o_custkey' AS edge_type, 'orders' AS src_table, 'customer' AS dst_table, o_orderkey AS src_id, o_custkey AS dst_id,
    t AS src_time, NULL::BIGINT AS dst_time FROM ord
  UNION ALL SELECT 'rev_f2p_o_custkey', 'customer', 'orders', o_custkey, o_orderkey, NULL, t FROM ord
  UNION ALL SELECT 'f2p_l_orderkey', 'lineitem', 'orders', id, l_orderkey, line.t, ord.t FROM line JOIN ord ON o_orderkey = l_orderkey
  UNION ALL SELECT 'rev_f2p_l_orderkey', 'orders', 'lineitem', l_orderkey, id, ord.t, line.t FROM line JOIN ord ON o_orderkey = l_orderkey
  UNION ALL SELECT 'f2p_l_partkey', 'lineitem', 'part', id, l_partkey, t, NULL FROM line
  UNION ALL SELECT 'rev_f2p_l_partkey', 'part', 'lineitem', l_partkey, id, NULL, t FROM line)"""


@BOOK.query("fk_edges", f"WITH {_LINE}, {_EDGES} SELECT * FROM edges")
def fk_edges(spark, sf_dir):
    return graph.sorted_edges(graph.fk_edges(_db(spark, sf_dir, keys_only=True)))


@BOOK.query(
    "node_table",
    f"WITH {_LINE} SELECT id AS row_id, t AS unix_time, l_linenumber, l_quantity, l_extendedprice FROM line",
)
def node_table(spark, sf_dir):
    return graph.node_table(_db(spark, sf_dir)["lineitem"])


_CUTS = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _stats_sql(table: str, col: str, kind: str, number: str) -> str:
    cuts = ", ".join(f"round(quantile_cont(({number})::DOUBLE, {f}), 6) AS {q}" for q, f in _CUTS.items())
    return f"""SELECT '{col}' AS "column", '{kind}' AS kind, count({col}) AS n, count(*) FILTER ({col} IS NULL) AS n_missing,
      round(avg({number}), 6) AS mean, round(stddev_pop({number}), 6) AS std, min({number})::DOUBLE AS low, max({number})::DOUBLE AS high, {cuts} FROM {table}"""


def _rounded_stats(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std", *_CUTS)})


@BOOK.query(
    "column_stats",
    " UNION ALL ".join(
        _stats_sql("lineitem", *x)
        for x in (
            ("l_linenumber", "categorical", "l_linenumber"), ("l_quantity", "numerical", "l_quantity"),
            ("l_shipdate", "timestamp", "epoch(l_shipdate)"), ("l_returnflag", "categorical", "length(l_returnflag)"),
        )
    ),
)
def column_stats(spark, sf_dir):
    lines = Table(
        read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag"),
        None, "l_shipdate", {"l_orderkey": "orders"},
    )
    return _rounded_stats(graph.node_stats(lines))


# numbers of the given tables, and columns with few values
_NUMBERS = {
    "lineitem": ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "orders": ("o_custkey", "o_totalprice"),
    "customer": ("c_nationkey", "c_acctbal"),
    "supplier": ("s_nationkey", "s_acctbal"),
    "part": ("p_size", "p_retailprice"),
    "documents": ("n_chars",),
    "conversations": ("turn",),
    "labels": ("quality", "toxic"),
    "embeddings": ("label",),
}
_VALUES = {
    "lineitem": ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"),
    "orders": ("o_orderstatus", "o_orderpriority"),
    "customer": ("c_mktsegment", "c_nationkey"),
    "part": ("p_brand", "p_size"),
    "documents": ("lang", "source"),
    "conversations": ("role",),
}


@BOOK.query(
    "column_quantiles",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, * FROM ({_stats_sql(t, c, "numerical", c)})""" for t, cols in _NUMBERS.items() for c in cols
    ),
)
def column_quantiles(spark, sf_dir):
    """Statistics with exact quartiles of the numbers of all given tables."""
    parts = [
        columns.column_stats(read(spark, sf_dir, t), dict.fromkeys(cols, columns.NUMERICAL)).select(F.lit(t).alias("table_name"), "*")
        for t, cols in _NUMBERS.items()
    ]
    return _rounded_stats(windows.union_all(parts))


@BOOK.query(
    "column_categories",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{c}' AS "column", {c}::VARCHAR AS category, count(*) AS n,
          (row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR))::INTEGER AS rank FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= 8"""
        for t, cols in _VALUES.items()
        for c in cols
    ),
)
def column_categories(spark, sf_dir):
    """The eight most frequent values of columns with few: the limit is the feature."""
    parts = [columns.top_categories(read(spark, sf_dir, t), cols, 8).select(F.lit(t).alias("table_name"), "*") for t, cols in _VALUES.items()]
    return windows.union_all(parts)


@BOOK.query(
    "category_counts",
    "SELECT p_brand AS category, count(*) AS n FROM part GROUP BY p_brand",
)
def category_counts(spark, sf_dir):
    return columns.category_counts(read(spark, sf_dir, "part"), "p_brand")


# columns of the given tables: t text, i whole number, other kinds by type
GIVEN = {
    "region": {"r_regionkey": "i", "r_name": "t"},
    "nation": {"n_nationkey": "i", "n_name": "t", "n_regionkey": "i"},
    "customer": {"c_custkey": "i", "c_name": "t", "c_nationkey": "i", "c_acctbal": "numerical", "c_mktsegment": "t"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "t", "o_totalprice": "numerical", "o_orderdate": "timestamp",
               "o_orderpriority": "t"},
    "documents": {"doc_id": "i", "text": "t", "lang": "t", "source": "t", "n_chars": "i"},
    "labels": {"doc_id": "i", "quality": "i", "toxic": "i"},
    "pages": {"page_id": "i", "url": "t", "html": "t"},
    "benchmark": {"item_id": "i", "text": "t"},
    "conversations": {"conv_id": "i", "turn": "i", "role": "t", "text": "t"},
}


def _kind_sql(table: str, column: str, kind: str) -> str:
    if kind not in ("t", "i"):
        return f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{kind}' AS kind"
    n, distinct = f"count({column})", f"count(DISTINCT {column})"
    rule = {
        "t": f"CASE WHEN {distinct} <= greatest({n}, 1) * 0.2 THEN 'categorical' ELSE 'text_embedded' END",
        "i": f"CASE WHEN {distinct} BETWEEN 1 AND 10 THEN 'categorical' ELSE 'numerical' END",
    }[kind]
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, {rule} AS kind FROM {table}"


# the other given tables, in queries of their own beside the nine
REST = {
    "supplier": {"s_suppkey": "i", "s_name": "t", "s_nationkey": "i", "s_acctbal": "numerical"},
    "part": {"p_partkey": "i", "p_name": "t", "p_brand": "t", "p_type": "t", "p_size": "i", "p_retailprice": "numerical"},
    "lineitem": {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "numerical",
                 "l_extendedprice": "numerical", "l_discount": "numerical", "l_tax": "numerical", "l_returnflag": "t",
                 "l_linestatus": "t", "l_shipdate": "timestamp"},
    "events": {"event_id": "i", "ts": "timestamp", "user_id": "i", "event_type": "t", "value": "numerical", "props": "t"},
    "embeddings": {"vec_id": "i", "embedding": "multicategorical", "label": "i"},
}


def _kinds_sql(tables: dict[str, dict[str, str]]) -> str:
    return " UNION ALL ".join(_kind_sql(t, c, k) for t, cols in tables.items() for c, k in cols.items())


KINDS_SQL = _kinds_sql(GIVEN)
REST_KINDS_SQL = _kinds_sql(REST)


def given_kinds(spark, sf_dir, tables=tuple(GIVEN)):
    """Kinds of all columns that the tables have."""
    return columns.database_kinds(Database({t: Table(read(spark, sf_dir, t)) for t in tables}))


@BOOK.query("infer_column_kinds", KINDS_SQL)
def infer_column_kinds(spark, sf_dir):
    return given_kinds(spark, sf_dir)


@BOOK.query("infer_column_kinds_rest", REST_KINDS_SQL)
def infer_column_kinds_rest(spark, sf_dir):
    return given_kinds(spark, sf_dir, REST)


def _churn(spark, sf_dir):
    return LABELS.queries["label_shop_user_churn"](spark, sf_dir).where(F.col("split") == "train").drop("split")


_CHURN = f"""churn AS (SELECT timestamp, customer_id, churn FROM ({LABELS.sql["label_shop_user_churn"]}) WHERE split = 'train'),
inp AS (SELECT *, row_number() OVER (ORDER BY timestamp, customer_id) - 1 AS input_id FROM churn)"""


@BOOK.query(
    "node_train_input",
    f"WITH {_CHURN} SELECT input_id, customer_id AS node, CAST(epoch(timestamp) AS BIGINT) AS unix_time, churn::DOUBLE AS target FROM inp",
)
def node_train_input(spark, sf_dir):
    return graph.node_train_input(_churn(spark, sf_dir), "customer_id", "churn", TaskKind.BINARY)


@BOOK.query(
    "attach_target",
    f"WITH {_CHURN} SELECT input_id, 7 AS batch, churn::DOUBLE AS target FROM inp WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def attach_target(spark, sf_dir):
    inputs = graph.node_train_input(_churn(spark, sf_dir), "customer_id", "churn", TaskKind.BINARY)
    poor = read(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)
    batch = inputs.join(poor, F.col("node") == F.col("c_custkey"), "left_semi").select("input_id", F.lit(7).alias("batch"))
    return graph.attach_target(batch, inputs)


def _rates(spark, sf_dir):
    return LABELS.queries["label_shop_user_item_rate"](spark, sf_dir).where(F.col("split") == "train").drop("split")


_RATES = f"""rate AS (SELECT timestamp, customer_id, product_id FROM ({LABELS.sql["label_shop_user_item_rate"]}) WHERE split = 'train'),
lists AS (SELECT timestamp, customer_id, row_number() OVER (ORDER BY timestamp, customer_id) - 1 AS input_id
  FROM (SELECT DISTINCT timestamp, customer_id FROM rate)),
link AS (SELECT input_id, rate.customer_id AS src, product_id AS dst, CAST(epoch(rate.timestamp) AS BIGINT) AS unix_time
  FROM rate JOIN lists ON lists.timestamp = rate.timestamp AND lists.customer_id = rate.customer_id)"""


def _link_input(spark, sf_dir):
    return graph.link_train_input(_rates(spark, sf_dir), "customer_id", "product_id")


@BOOK.query("link_train_input", f"WITH {_RATES} SELECT * FROM link")
def link_train_input(spark, sf_dir):
    return _link_input(spark, sf_dir)


@BOOK.query(
    "csr_lookup",
    f"WITH {_RATES} SELECT input_id, dst FROM link WHERE src IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def csr_lookup(spark, sf_dir):
    """True destinations of the rows of some sources, read from the stored adjacency of rows and destinations."""
    inputs = cut_lineage(_link_input(spark, sf_dir))
    path = work_path(spark, "adjacency")
    adjacency.write_adjacency(inputs.select("input_id", "dst"), path)
    poor = read(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)
    wanted = inputs.join(poor, F.col("src") == F.col("c_custkey"), "left_semi").select("input_id")
    return adjacency.neighbors(spark, path, wanted).withColumnRenamed("src", "input_id")


@BOOK.query(
    "link_triples",
    f"""WITH {_RATES}, pick AS (SELECT *, row_number() OVER (PARTITION BY input_id, src, unix_time ORDER BY {draw_sql(42, "input_id", "dst")}, dst) AS n
      FROM link) SELECT input_id, src, unix_time, dst AS pos_dst, {draw_sql(43, "input_id", "src")} % (SELECT count(*) FROM part) AS neg_dst
    FROM pick WHERE n = 1""",
)
def link_triples(spark, sf_dir):
    return graph.link_triples(_link_input(spark, sf_dir), read(spark, sf_dir, "part").count(), 42)


@BOOK.query(
    "negative_pairs",
    f"""WITH {_RATES} SELECT timestamp, customer_id, product_id, 1 AS label FROM rate UNION ALL
    SELECT timestamp, customer_id, {draw_sql(42, "timestamp", "customer_id", "product_id")} % (SELECT count(*) FROM part), 0 FROM rate""",
)
def negative_pairs(spark, sf_dir):
    pairs = _rates(spark, sf_dir)
    n = read(spark, sf_dir, "part").count()
    return links.labelled_pairs(pairs, links.negative_pairs(pairs, "product_id", n, 42))


@BOOK.query(
    "is_linked",
    f"""WITH {_RATES}, cand AS (SELECT DISTINCT l.input_id, o.dst FROM link l JOIN link o ON o.input_id = l.input_id + 1)
    SELECT cand.input_id, cand.dst, link.dst IS NOT NULL AS is_linked FROM cand LEFT JOIN link ON link.input_id = cand.input_id AND link.dst = cand.dst""",
)
def is_linked(spark, sf_dir):
    """Whether the next row's destinations are also true for a row."""
    inputs = _link_input(spark, sf_dir).select("input_id", "dst")
    shifted = inputs.select((F.col("input_id") - 1).alias("input_id"), "dst").where(F.col("input_id") >= 0)
    known = shifted.join(inputs.select("input_id").distinct(), "input_id", "left_semi").distinct()
    return links.is_linked(known, inputs, ["input_id", "dst"])


_SEEDS = """seeds AS (SELECT c_custkey * 100 + k AS seed_id, c_custkey, CAST(epoch(TIMESTAMP '1997-01-01' + 91 * k * INTERVAL 1 DAY) AS BIGINT) AS seed_time
  FROM customer, generate_series(0, 11) AS g(k))"""


def _seeds(spark, sf_dir):
    """Every customer at every anchor."""
    spread = windows.spread_since(read(spark, sf_dir, "customer").select("c_custkey"), [GRID])
    return spread.select(
        (F.col("c_custkey") * 100 + windows.anchor_number([GRID])).alias("seed_id"),
        F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("seed_time"),
        F.col("c_custkey").alias("node_id"),
    )


def _order_asks(spark, sf_dir):
    return _seeds(spark, sf_dir).select(
        "seed_id", "seed_time", F.lit("f2p_o_custkey").alias("edge_type"), F.lit("orders").alias("src_table"),
        F.lit("customer").alias("dst_table"), F.col("node_id").alias("dst_id"),
    )


@BOOK.query(
    "temporal_neighbors_last",
    f"""WITH {_LINE}, {_SEEDS}, r AS (SELECT seed_id, seed_time, c_custkey AS dst_id, o_orderkey AS src_id, t AS src_time,
      row_number() OVER (PARTITION BY seed_id ORDER BY t DESC, o_orderkey DESC) AS n FROM seeds JOIN ord ON o_custkey = c_custkey AND t <= seed_time)
    SELECT seed_id, seed_time, dst_id, src_id, src_time FROM r WHERE n <= 4""",
)
def temporal_neighbors_last(spark, sf_dir):
    """The four latest orders of each customer before each anchor."""
    edges = graph.fk_edges(_db(spark, sf_dir, "customer", "orders"), into={"customer"})
    found = graph.temporal_neighbors(edges, _order_asks(spark, sf_dir), 4, "last")
    return found.select("seed_id", "seed_time", "dst_id", "src_id", "src_time")


@BOOK.query(
    "temporal_neighbors_all",
    f"""WITH {_LINE}, {_SEEDS} SELECT seed_id, seed_time, c_custkey AS dst_id, o_orderkey AS src_id, t AS src_time
    FROM seeds JOIN ord ON o_custkey = c_custkey AND t <= seed_time""",
)
def temporal_neighbors_all(spark, sf_dir):
    edges = graph.fk_edges(_db(spark, sf_dir, "customer", "orders"), into={"customer"})
    found = graph.temporal_neighbors(edges, _order_asks(spark, sf_dir), -1)
    return found.select("seed_id", "seed_time", "dst_id", "src_id", "src_time")


_SAMPLE_SEED, _FAN_OUT = 42, graph.halving(8, 2)
_EDGE_OUT = "seed_id, seed_time, edge_type, src_table, dst_table, dst_id, src_id, src_time"


def _hop_sql(hop: int, asks: str) -> str:
    """CTEs ``hop<n>``: the edges that a hop keeps, by the same permutation."""
    k = _FAN_OUT[hop - 1]
    return f"""
seen{hop} AS (SELECT a.*, e.edge_type, e.src_table, e.src_id, e.src_time,
  row_number() OVER (PARTITION BY seed_id, e.edge_type, e.src_table, dst_id ORDER BY coalesce(src_time, {graph.NEVER_BEFORE}), src_id) AS pos,
  count(*) OVER (PARTITION BY seed_id, e.edge_type, e.src_table, dst_id) AS n
  FROM ({asks}) a JOIN edges e USING (dst_table, dst_id) WHERE e.src_time IS NULL OR e.src_time <= seed_time),
many{hop} AS (SELECT DISTINCT {", ".join(graph.ASK)}, n FROM seen{hop} WHERE n > {k}),
keyed{hop} AS (SELECT *, {half_bits_sql("n")} AS b, {round_keys_sql(_SAMPLE_SEED + hop, *graph.ASK)} AS keys FROM many{hop}),
walk{hop} AS (SELECT *, i::BIGINT AS x, 0 AS step FROM keyed{hop}, generate_series(0, {k - 1}) g(i)
  UNION ALL SELECT * REPLACE ({permuted_sql("x", "b", "keys")} AS x, step + 1 AS step) FROM walk{hop} WHERE step = 0 OR x >= n),
hop{hop} AS (SELECT {_EDGE_OUT}, {hop} AS hop FROM seen{hop} WHERE n <= {k}
  UNION ALL SELECT {", ".join(f"s.{c}" for c in _EDGE_OUT.split(", "))}, {hop} FROM seen{hop} s JOIN walk{hop} w
    ON {" AND ".join(f"s.{c} = w.{c}" for c in graph.ASK)} AND s.pos = w.x + 1 WHERE step > 0 AND x < w.n)"""


@BOOK.query(
    "temporal_neighbor_sample",
    f"""WITH RECURSIVE {_LINE}, {_EDGES}, {_SEEDS},
    {_hop_sql(1, "SELECT seed_id, seed_time, 'customer' AS dst_table, c_custkey AS dst_id FROM seeds")},
    {_hop_sql(2, "SELECT DISTINCT seed_id, seed_time, src_table AS dst_table, src_id AS dst_id FROM hop1")}
    SELECT * FROM hop1 UNION ALL SELECT * FROM hop2""",
)
def temporal_neighbor_sample(spark, sf_dir):
    """Two hops from every customer at every anchor, fan-out 8 and 4: uniform subsets of what each may see."""
    db = _db(spark, sf_dir, keys_only=True)
    return graph.sample_subgraphs(db, "customer", _seeds(spark, sf_dir), _FAN_OUT, "uniform", _SAMPLE_SEED)


@BOOK.query(
    "neighbor_sample_sizes",
    f"""WITH {_LINE}, {_SEEDS}, one AS (SELECT seed_id, least(8, count(*)) AS n, max(t) <= max(seed_time) AS in_time
      FROM seeds JOIN ord ON o_custkey = c_custkey AND t <= seed_time GROUP BY seed_id)
    SELECT seed_id, 'f2p_o_custkey' AS edge_type, n, in_time, n AS n_distinct FROM one""",
)
def neighbor_sample_sizes(spark, sf_dir):
    """First hop of the uniform sample: exactly min(8, visible) different neighbours, none from the future."""
    db = _db(spark, sf_dir, "customer", "orders")
    sampled = graph.sample_subgraphs(db, "customer", _seeds(spark, sf_dir), [8], "uniform", 42)
    return sampled.groupBy("seed_id", "edge_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("src_time") <= F.col("seed_time")).alias("in_time"),
        F.count_distinct("src_id").alias("n_distinct"),
    )


@BOOK.query(
    "batch_sizes",
    f"""WITH {_CHURN}, n AS (SELECT CAST(epoch(timestamp) AS BIGINT) AS unix_time, count(*) // 64 AS b FROM inp GROUP BY 1)
    SELECT unix_time, b AS n_batches, b * 64 AS n_rows, 64::BIGINT AS smallest FROM n WHERE b > 0""",
)
def batch_sizes(spark, sf_dir):
    """Batches of one time are full, and as many as fit."""
    inputs = graph.node_train_input(_churn(spark, sf_dir), "customer_id", "churn", TaskKind.BINARY)
    sizes = graph.same_time_batches(inputs, 64, 42).groupBy("unix_time", "batch").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("unix_time").agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n_rows"), F.min("n").alias("smallest")
    )


@BOOK.query(
    "triples_are_true",
    f"WITH {_RATES} SELECT DISTINCT input_id, src, unix_time, TRUE AS pos_is_linked, TRUE AS neg_is_known FROM link",
)
def triples_are_true(spark, sf_dir):
    """Every positive is a true link of its row, every negative an existing item."""
    inputs, parts = _link_input(spark, sf_dir), read(spark, sf_dir, "part")
    triples = graph.link_triples(inputs, parts.count(), 42).withColumnRenamed("pos_dst", "dst")
    checked = links.is_linked(triples, inputs, ["input_id", "dst"])
    known = parts.select(F.col("p_partkey").alias("neg_dst"), F.lit(True).alias("known"))
    return checked.join(known, "neg_dst", "left").select(
        "input_id", "src", "unix_time", F.col("is_linked").alias("pos_is_linked"),
        F.coalesce("known", F.lit(False)).alias("neg_is_known"),
    )


@BOOK.query(
    "negative_pair_counts",
    f"WITH {_RATES} SELECT customer_id, count(*) AS n_true, count(*) AS n_drawn FROM rate GROUP BY customer_id",
)
def negative_pair_counts(spark, sf_dir):
    """As many drawn pairs as true ones, source by source."""
    pairs = _rates(spark, sf_dir)
    drawn = links.negative_pairs(pairs, "product_id", read(spark, sf_dir, "part").count(), 42)
    labelled = links.labelled_pairs(pairs, drawn)
    return labelled.groupBy("customer_id").agg(
        F.count_if(F.col("label") == 1).alias("n_true"), F.count_if(F.col("label") == 0).alias("n_drawn")
    )


@BOOK.query(
    "text_vector_length",
    "SELECT doc_id, 32 AS width, CASE WHEN regexp_matches(text, '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents",
)
def text_vector_length(spark, sf_dir):
    """Text vectors have their width and length 1."""
    vectors = hash_embedding(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "v", 32)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select("doc_id", F.size("v").alias("width"), F.round(norm, 9).alias("norm"))


@BOOK.query(
    "same_time_batches",
    f"""WITH {_CHURN}, rows_ AS (SELECT input_id, customer_id AS node, CAST(epoch(timestamp) AS BIGINT) AS unix_time, churn::DOUBLE AS target FROM inp),
    n AS (SELECT *, (row_number() OVER (PARTITION BY unix_time ORDER BY {draw_sql(42, "input_id")}, input_id) - 1) // 64 AS batch,
      count(*) OVER (PARTITION BY unix_time) AS size FROM rows_)
    SELECT input_id, node, unix_time, target, batch FROM n WHERE batch < size // 64""",
)
def same_time_batches(spark, sf_dir):
    inputs = graph.node_train_input(_churn(spark, sf_dir), "customer_id", "churn", TaskKind.BINARY)
    return graph.same_time_batches(inputs, 64, 42)


@BOOK.query(
    "neighbor_aggregate",
    """WITH o AS (SELECT o_custkey AS dst_id, avg(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT 'customer' AS dst_table, dst_id, round(v, 8) AS value FROM o UNION ALL
    SELECT 'orders', l_orderkey, round(avg(l_extendedprice), 8) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2
    UNION ALL SELECT 'part', l_partkey, round(avg(l_extendedprice), 8) FROM lineitem GROUP BY 2""",
)
def neighbor_aggregate(spark, sf_dir):
    """Mean value of the facts around customers, orders and parts."""
    db = _db(spark, sf_dir)
    values = {
        "orders": db.df("orders").select("row_id", F.col("o_totalprice").alias("value")),
        "lineitem": db.df("lineitem").select("row_id", F.col("l_extendedprice").alias("value")),
    }
    facts = graph.fk_edges(db).where(F.col("edge_type").startswith("f2p_"))
    return graph.neighbor_aggregate(facts, values, ["value"]).withColumn("value", F.round("value", 8))


@BOOK.query("text_hash_embedding", weighted_embedding_sql("documents", "doc_id", "text", "vector", 32, 6))
def text_hash_embedding(spark, sf_dir):
    """Texts as vectors by signed hashing, rare words weighing more."""
    vectors = weighted_embedding(read(spark, sf_dir, "documents"), "doc_id", "text", "vector", 32)
    return vectors.select("doc_id", F.transform("vector", lambda x: F.round(x, 6) + F.lit(0.0)).alias("vector"))


@BOOK.query("text_reduced_embedding")
def text_reduced_embedding(spark, sf_dir):
    """The eight numbers that keep most of what the vectors of all texts say."""
    vectors = weighted_embedding(read(spark, sf_dir, "documents"), "doc_id", "text", "vector", 64)
    return reduced_embedding(cut_lineage(vectors), "vector", 8)


def past_labels(labels, entity, target):
    """Mean and number of an entity's training labels at earlier anchors: never the row's own, nor later ones."""
    known = F.when(F.col("split") == "train", F.col(target).cast("double"))
    # an entity has one label per anchor, so its rows are few
    before = Window.partitionBy(entity).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    return labels.withColumns(
        {f"past_{target}": F.avg(known).over(before), "past_rows": F.count(known).over(before)}
    )


@BOOK.query(
    "boosted_features",
    f"""WITH lab AS ({LABELS.sql["label_shop_user_churn"]}) SELECT split, timestamp, customer_id, churn, c_acctbal, c_mktsegment,
    round(avg(CASE WHEN split = 'train' THEN churn END) OVER w, 9) AS past_churn, count(CASE WHEN split = 'train' THEN churn END) OVER w AS past_rows
    FROM lab LEFT JOIN customer ON c_custkey = customer_id
    WINDOW w AS (PARTITION BY customer_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def boosted_features(spark, sf_dir):
    """What the boosted trees see of each label row, none of it later than the row."""
    labels = get_task("shop", "user-churn").labels(DATASETS["shop"](spark, sf_dir))
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), "c_acctbal", "c_mktsegment")
    wide = past_labels(labels.join(customer, "customer_id", "left"), "customer_id", "churn")
    return wide.select(
        "split", "timestamp", "customer_id", "churn", "c_acctbal", "c_mktsegment", F.round("past_churn", 9).alias("past_churn"), "past_rows"
    )


@BOOK.query("boosted_tree_baseline")
def boosted_tree_baseline(spark, sf_dir):
    """Churn of customers from their features and past labels, by gradient boosted trees."""
    from chronograin.operators.joins import feature_join

    task, dataset = get_task("shop", "user-churn"), DATASETS["shop"](spark, sf_dir)
    labels = task.labels(dataset)
    customer = Table(
        read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "customer_id"), "customer_id", None, {"c_nationkey": "nation"}
    )
    wide = past_labels(feature_join(labels, "customer_id", customer), "customer_id", "churn")
    kinds = {"c_acctbal": "numerical", "c_mktsegment": "categorical", "past_churn": "numerical", "past_rows": "numerical"}
    # all splits come from one pass over the facts
    wide = cut_lineage(wide.select("split", "timestamp", "customer_id", "churn", *kinds))
    fit_on, tune_on, test = (wide.where(F.col("split") == s) for s in ("train", "val", "test"))
    model, _ = boosted.fit_boosted(fit_on, tune_on, "churn", kinds, TaskKind.BINARY)
    return boosted.predict(model, test, kinds).select("timestamp", "customer_id", "churn", "pred")


