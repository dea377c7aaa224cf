"""Packing: length buckets of least padding by dynamic programming, token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import only
from .work import Workspace

BUCKETS, BUDGET = 16, 65_536
CHUNK_ROWS = 20_000


def n_tokens(text: Column) -> Column:
    """Words between space and 0x09-0x0D, and one end."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != ""))).cast("long") + 1


def _layer(best: np.ndarray, length: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every j the least best[i] + padding of lengths i..j-1 in one bucket over i < j, and the first such i.

    The first best i never falls as j grows (the padding is a Monge cost), so the j in the middle of a range splits
    the range of i for either half; each level of halves is one vectorised pass over all i.
    """
    m = len(best) - 1
    new, cut = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    j0, j1, i0, i1 = (np.array([x], np.int64) for x in (1, m, 0, m - 1))
    while len(j0):
        j = (j0 + j1) // 2
        size = np.minimum(i1, j - 1) - i0 + 1
        first = np.cumsum(size) - size
        at = np.repeat(np.arange(len(j)), size)
        i = np.arange(size.sum()) - first[at] + i0[at]
        value = best[i] + length[j - 1][at] * (c[j][at] - c[i]) - (s[j][at] - s[i])
        low = np.minimum.reduceat(value, first)
        hit = np.flatnonzero(value == low[at])
        opt = i[hit[np.searchsorted(at[hit], np.arange(len(j)))]]
        new[j], cut[j] = low, opt
        ends = np.concatenate([j0, j + 1]), np.concatenate([j - 1, j1]), np.concatenate([i0, opt]), np.concatenate([opt, i1])
        j0, j1, i0, i1 = (x[ends[0] <= ends[1]] for x in ends)
    return new, cut


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` upper ends among sorted distinct lengths that minimise sum(count * (end - length))."""
    m = len(lengths)
    if m <= buckets:
        return [int(x) for x in lengths]
    length, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    c, s = (np.append(0, np.cumsum(x)) for x in (counts, counts * length))
    best = np.append(0, length * c[1:] - s[1:])
    cuts = []
    for _ in range(buckets - 1):
        best, cut = _layer(best, length, c, s)
        cuts.append(cut)
    ends, j = [int(length[-1])], m
    for cut in reversed(cuts):
        if (j := int(cut[j])) == 0:
            break
        ends.append(int(length[j - 1]))
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, bucket, batch, slot): one row for each row.

    ``bucket`` is the padded length: of at most ``buckets`` ends over the global length histogram those of least
    total padding; of equally good ones those whose last buckets reach furthest down. Within a bucket the rows, in
    order of the MD5 digest of doc_id, then doc_id and length, fill batches of max(1, budget // bucket) rows; ``slot``
    is the place in the batch, from 0. Every batch of a bucket but the last is full. A null or empty text is one token,
    the end. A row longer than the budget has a batch of its own. Rows with null or repeated ids are packed like
    others, null ids first. An empty table gives an empty one; further columns are ignored.

    The histogram is collected: m distinct lengths take m * m / 2 tokens at least, so that 10^13 tokens have at
    most 4.5 million of them.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark)
    src = ws.save(only(docs, "doc_id", "text").select("doc_id", n_tokens(F.col("text")).alias("n_tokens")), "lengths")
    histogram = src.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    lengths, counts = (histogram.column(i).to_numpy() for i in range(2))
    total = int(counts.sum())
    if not total:
        return src.select("doc_id", "n_tokens", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    ends = boundaries(lengths, counts, buckets)
    bucket = F.coalesce(*(F.when(F.col("n_tokens") <= e, F.lit(e)) for e in ends)).cast("long")
    # Ranks in two levels: a bucket falls into hash ranges of bounded size, each is numbered in its own
    # task, and the counts of the ranges before it are added.
    chunks = -(-total // CHUNK_ROWS)
    digest = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    part = F.coalesce(F.conv(F.substr("h", F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(0))
    keyed = src.withColumn("bucket", bucket).withColumn("h", digest).withColumn("chunk", F.floor(part * chunks / 2.0**32))
    sizes = keyed.groupBy("bucket", "chunk").count()
    before = sizes.select("bucket", "chunk", (F.sum("count").over(Window.partitionBy("bucket").orderBy("chunk")) - F.col("count")).alias("before"))
    numbered = keyed.withColumn("n", F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("h", "doc_id", "n_tokens")) - 1).join(before, ["bucket", "chunk"])
    nth, room = F.col("n") + F.col("before"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    return numbered.select("doc_id", "n_tokens", "bucket", F.floor(nth / room).cast("long").alias("batch"), (nth % room).cast("long").alias("slot"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets and batches of the whole documents table."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches of what is left: doc_id, n_tokens, bucket, batch, slot; nulls, repeats and empty tables as in pack()."""
    return pack(docs)


def _sql(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The dynamic programme layer by layer over all pairs of distinct lengths, then the ends from the last one down."""
    layers, ends = ["l1 AS MATERIALIZED (SELECT j, n * c - s AS cost, 0 AS i FROM h UNION ALL SELECT 0, 0, 0)"], [f"e{buckets} AS (SELECT max(j) AS j FROM h)"]
    for k in range(2, buckets + 1):
        layers.append(
            f"l{k} AS MATERIALIZED (SELECT j, x.cost AS cost, x.i AS i FROM (SELECT h.j, min({{'cost': l.cost + h.n * (h.c - coalesce(g.c, 0)) - (h.s - coalesce(g.s, 0)), 'i': l.j}}) AS x "
            f"FROM h JOIN l{k - 1} l ON l.j < h.j LEFT JOIN h g ON g.j = l.j GROUP BY h.j) UNION ALL SELECT 0, 0, 0)"
        )
    for k in range(buckets - 1, 0, -1):
        ends.append(f"e{k} AS (SELECT i AS j FROM l{k + 1} JOIN e{k + 1} USING (j))")
    return rf"""
WITH t AS MATERIALIZED (
  SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '')) + 1 AS BIGINT) AS n_tokens FROM documents
), h AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY n) AS INT) AS j, CAST(n AS BIGINT) AS n, CAST(sum(k) OVER (ORDER BY n) AS BIGINT) AS c, CAST(sum(k * n) OVER (ORDER BY n) AS BIGINT) AS s
  FROM (SELECT n_tokens AS n, count(*) AS k FROM t GROUP BY 1)
), {", ".join(layers)}, {", ".join(ends)}, ends AS (
  SELECT DISTINCT h.n AS bucket FROM h JOIN ({" UNION ALL ".join(f"SELECT j FROM e{k}" for k in range(1, buckets + 1))}) USING (j)
), placed AS (
  SELECT doc_id, n_tokens, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, n_tokens) - 1 AS nth FROM t ASOF JOIN ends ON t.n_tokens <= ends.bucket
)
SELECT doc_id, n_tokens, bucket, nth // greatest(1, {budget} // bucket) AS batch, nth % greatest(1, {budget} // bucket) AS slot FROM placed
"""


OP2_SQL = _sql()
