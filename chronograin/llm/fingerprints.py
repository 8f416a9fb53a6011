"""Document fingerprints: weighted 64-bit SimHash in DataFrame functions only.

The terms of a text are its neighbouring word pairs (the last word stands alone), hashed to 64 bits and weighted by
their letters; a bit is set if the terms that have it weigh more than half. Votes are counted two bits
to a number: 32 sums of one bit from the lower and one from the upper half of the hash, in the two halves of a
bigint, so a text of up to 2^31 letters is counted exactly. The words of a text never leave the task that holds
the text, and sums are partial.

``within_radius`` finds all fingerprints within a Hamming radius of given ones: the bits fall into
radius + 2 blocks, any two fingerprints within the radius agree in two of them, and one table for
each pair of blocks, keyed by their bits (the permutation that brings them to the front), is joined.

Each document is compared with an edited copy of itself, whose last third comes from the next document in
descending order of doc_id. Only (id, hash, length) are sorted to find the next documents; texts are
shuffled once, and the prefixes that replace the ends once more.

Defined results: a NULL text counts as empty; an empty text has fingerprint zero; rows with a NULL
doc_id come last in the order, rows of one doc_id in the order of their texts' hashes; rows alike in both
are copies that follow one another; a single document is its own next; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograin.llm.common import settle, stored
from chronograin.operators.running import dense_row_ids

BITS = 64
RADIUS = 3
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LANES = 0x0000000100000001
KEY = ["k1", "k2"]




def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("bigint")


def fingerprints(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by.., fp): the fingerprint of the text of each ``by``; texts without words have no row.

    Rows of ``by`` should be partitioned by some of its columns already, so that nothing is shuffled.
    """
    words = texts.select(*by, F.regexp_extract_all(F.lower(text), F.lit(WORD), 0).alias("w"))
    pairs = F.zip_with(
        "w",
        F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))),
        lambda a, b: F.struct(
            F.xxhash64(a, b).alias("h"), (F.length(a) + F.coalesce(F.length(b), F.lit(0))).cast("bigint").alias("n")
        ),
    )
    terms = words.select(*by, F.inline(pairs))
    lanes = [
        F.sum(F.shiftright("h", j).bitwiseAND(F.lit(_LANES)) * F.col("n")).alias(f"s{j}") for j in range(BITS // 2)
    ]
    votes = terms.groupBy(*by).agg(F.sum("n").alias("all"), *lanes)
    bits = []
    for j in range(BITS // 2):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"s{j}", 32)
        for at, votes_for in ((j, low), (j + 32, high)):
            bits.append(F.when(votes_for * 2 > F.col("all"), _signed(1 << at)).otherwise(F.lit(0).cast("bigint")))
    # a balanced tree of ORs: a chain of 64 would be one deep expression
    while len(bits) > 1:
        bits = [reduce(Column.bitwiseOR, bits[i : i + 4]) for i in range(0, len(bits), 4)]
    return votes.select(*by, bits[0].alias("fp"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal bits."""
    left, right = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.lit(1.0) - F.bit_count(left.bitwiseXOR(right)) / F.lit(float(BITS))


def block_keys(fp: Column, radius: int) -> Column:
    """The keys of a fingerprint in all block tables: the table's number and the bits of its two blocks."""
    n = radius + 2
    edges = [BITS * i // n for i in range(n + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    return F.array(
        *[
            F.struct(F.lit(t).alias("t"), fp.bitwiseAND(_signed(masks[i] | masks[j])).alias("bits"))
            for t, (i, j) in enumerate(combinations(range(n), 2))
        ]
    )


def within_radius(queries: DataFrame, stored_fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fp, distance): distinct fingerprints ``fp`` of both tables that differ in at most ``radius`` bits."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.where(F.col("fp").isNotNull()).select(F.col("fp").alias(name)).distinct()
        return distinct.select(name, F.inline(block_keys(F.col(name), radius)))

    met = keyed(queries, "query").join(keyed(stored_fps, "fp"), ["t", "bits"])
    apart = met.select("query", "fp", F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))).alias("distance"))
    return apart.where(F.col("distance") <= radius).distinct()


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) of every row."""
    settle(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    named = docs.select(
        "doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("k1"),
        F.xxhash64(F.col("doc_id").isNull(), text).alias("k2"),
    )
    lengths = named.groupBy(*KEY, "doc_id", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("copies"))
    placed = stored(dense_row_ids(lengths, [F.col("doc_id").desc_nulls_last(), F.col("k2")], "at"), "fingerprint-order")
    last = placed.agg(F.max("at")).first()[0] or 0
    following = placed.select(
        F.col("k1").alias("next1"), F.col("k2").alias("next2"),
        F.when(F.col("at") == 0, F.lit(last)).otherwise(F.col("at") - 1).alias("at"),
    )
    # copies follow one another: all but the last of them have themselves as next
    chained = placed.join(following, "at").withColumn("own", F.explode(F.expr("IF(copies > 1, array(false, true), array(false))")))
    asks = stored(
        chained.select(
            *KEY, "doc_id", "n", "own", F.when(F.col("own"), F.col("copies") - 1).otherwise(1).alias("times"),
            F.when(F.col("own"), F.col("k1")).otherwise(F.col("next1")).alias("next1"),
            F.when(F.col("own"), F.col("k2")).otherwise(F.col("next2")).alias("next2"),
        ), "fingerprint-next"
    )

    texts = named.select(*KEY, "text").repartition(*KEY).distinct()
    wanted = asks.select(*KEY, "own", F.col("next1"), F.col("next2"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    ends = (
        texts.select(F.col("k1").alias("next1"), F.col("k2").alias("next2"), "text")
        .join(wanted.hint("shuffle_hash"), ["next1", "next2"])
        .select(*KEY, "own", "k", F.substring("text", F.lit(1), F.col("k")).alias("end"))
    )
    edited = texts.join(ends.hint("shuffle_hash"), KEY).select(
        *KEY, "own", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("k")), "end").alias("edited"),
    )
    whole = stored(fingerprints(texts, KEY), "fingerprints")
    zero = F.lit(0).cast("bigint")
    changed = stored(
        edited.select(*KEY, "own", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")).join(
            fingerprints(edited, [*KEY, "own"], "edited").withColumnRenamed("fp", "edited_fp"), [*KEY, "own"], "left"
        ), "fingerprint-edits"
    )
    ahead = whole.select(F.col("k1").alias("next1"), F.col("k2").alias("next2"), F.col("fp").alias("next_fp"))
    found = (
        asks.join(changed, [*KEY, "own"])
        .join(whole, KEY, "left")
        .join(ahead, ["next1", "next2"], "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("fp", "edited_fp", "next_fp")})
        .withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times").cast("bigint"))))
    )
    return found.select(
        "doc_id", F.col("n").cast("bigint").alias("n_chars"), "edited_sha256", "fp", "edited_fp",
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
