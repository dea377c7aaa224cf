"""MinHash near-duplicates: banded universal-hash minima, verified links, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .text import U, WordHashes, batches, mixed, numbered, only, place, released, shingles, squeezed, unsqueezed, words
from .work import Workspace

BANDS, ROWS, K = 30, 6, 5
#: A pair at the threshold agrees on 153 of 180 minima; this is more than six deviations less.
LEAST_AGREEMENT = 120
#: Members of a bucket that one task holds of either side.
BLOCK = 128


def _family(n: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift: (a*x + b) >> 32 over 32-bit x is strongly universal for uniform 64-bit a and b."""
    r = np.random.Generator(np.random.PCG64(seed))
    draw = lambda: r.integers(0, 2**64, (n, 1), dtype=np.uint64)
    return draw() | U(1), draw()


A, B = _family(BANDS * ROWS)


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of a non-empty shingle set, as 32-bit numbers."""
    x = (s >> U(32))[None, :]
    low = np.full(len(A), ~U(0))
    for i in range(0, x.shape[1], 1024):
        np.minimum(low, (A * x[:, i : i + 1024] + B).min(axis=1), out=low)
    return (low >> U(32)).astype(np.uint32)


def _sets(texts: list[str | None], cache: WordHashes, k: int) -> list[np.ndarray]:
    return [np.unique(shingles(cache.array(words(t)), k)) for t in texts]


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=at[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(at, pa.array(flat.astype(kind)))


def _banded(k: int):
    salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    none = np.zeros(0, np.int64)

    def run(it):
        cache = WordHashes()

        def one(b):
            n, keys, bands = [], [], []
            for s in _sets(b.column(1).to_pylist(), cache, k):
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    bands.append(none)
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig = signature(s).astype(np.uint64).reshape(BANDS, ROWS)
                h = salt.copy()
                for j in range(ROWS):
                    h = mixed(h * U(31) + sig[:, j])
                bands.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), _lists(bands, np.int64)], names=["doc_id", "n", "key", "bands"])

        yield from batches(one)(it)

    return run


def _featured(k: int):
    def run(it):
        cache = WordHashes()

        def one(b):
            sets = _sets(unsqueezed(b.column(1)), cache, k)
            sigs = [signature(s).tobytes() if len(s) else b"" for s in sets]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), _lists([s.view(np.int64) for s in sets], np.int64)], names=["key", "sig", "items"])

        yield from batches(one)(it)

    return run


def _agreeing(least: int):
    def one(b):
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in (b.column(2), b.column(3)))
        keep = pa.array((x == y).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(keep)

    return batches(one)


def _links(pairs: DataFrame, feats: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs, those whose signatures agree and whose full sets reach the threshold."""
    of = lambda side, *cols: feats.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols))
    near = pairs.join(of("a", "sig"), "a").join(of("b", "sig"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing(LEAST_AGREEMENT), "a long, b long")
    both = F.size(F.array_intersect("items_a", "items_b"))
    full = near.join(of("a", "items"), "a").join(of("b", "items"), "b")
    return full.where(100 * both >= percent * (F.size("items_a") + F.size("items_b") - both)).select("a", "b")


def _forest(ids: np.ndarray, comps: np.ndarray, items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among sets of one block, enough to connect what full-set comparison connects."""
    n = len(ids)
    sizes = np.array([len(s) for s in items])
    flat, owner = np.concatenate(items), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    col = np.cumsum(new) - 1
    often = np.bincount(col) > 1
    at = (np.cumsum(often) - 1)[col]
    keep = often[col]
    owner, at = owner[keep], at[keep]
    shared = np.zeros((n, n), np.float32)
    for c in range(0, int(often.sum()), 8192):
        part = (at >= c) & (at < c + 8192)
        x = np.zeros((n, 8192), np.float32)
        x[owner[part], at[part] - c] = 1
        shared += x @ x.T
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    linked |= comps[:, None] == comps[None, :]
    out, label = [], np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1)
        if (low == label).all():
            break
        label = np.minimum(label, low)
    for i in np.flatnonzero(label != np.arange(n)):
        if comps[i] != comps[label[i]]:
            out.append((int(ids[label[i]]), int(ids[i])))
    return out


def _blocks(percent: int):
    """Over rows (task, id, c, items) sorted by task: the links within each task's block."""

    def run(it):
        task, rows = None, []

        def done():
            links = _forest(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], percent) if len({r[1] for r in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for b in it:
            if not b.num_rows:
                continue
            values, ends = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy(zero_copy_only=False)
            for i, (t, x, c) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if t != task:
                    if len(rows) > 1:
                        yield done()
                    task, rows = t, []
                rows.append((x, c, values[ends[i] : ends[i + 1]].copy()))
        if len(rows) > 1:
            yield done()

    return run


def _mixed(left: DataFrame, feats: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Links between the components that still share a bucket.

    In a bucket, the component of its smallest class is left as it is; every other member (O) has to meet all
    members (A and O), for which both are dealt into blocks of at most BLOCK, by hash. A task has one block of
    each, so its size is bounded; where one component has nearly everything, as in a large group of near
    copies, O is one block and A's rows go out once. Only links that connect something leave a task.
    """
    live = left.join(comp, "id", "left").select("id", "n", "bucket", F.coalesce("component", "id").alias("c"))
    heads = live.groupBy("bucket").agg(F.min(F.struct("id", "c")).alias("head"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    heads = heads.where("lo != hi").where(~((F.col("m") == 2) & (100 * F.col("n_lo") < percent * F.col("n_hi")))).select("bucket", F.col("head.c").alias("main"))
    met = live.join(heads, "bucket").withColumn("o", F.col("c") != F.col("main"))
    parts = met.groupBy("bucket").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(F.when(x, 1).otherwise(0)) / BLOCK)).cast("int").alias(k) for k, x in (("na", ~F.col("o")), ("no", F.col("o")))))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.when(F.col("o"), F.col("no")).otherwise(F.col("na"))).cast("int")
    dealt = met.join(parts, "bucket").withColumn("k", own)
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    to = F.when(F.col("o"), F.concat(F.transform(span("na"), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("k").alias("j"))), F.filter(F.transform(span("no"), lambda i: F.struct(F.lit(1).alias("kind"), F.least(i, F.col("k")).alias("i"), F.greatest(i, F.col("k")).alias("j"))), lambda s: s["i"] != s["j"])))
    to = to.otherwise(F.transform(span("no"), lambda j: F.struct(F.lit(0).alias("kind"), F.col("k").alias("i"), j.alias("j"))))
    rows = dealt.select("id", "c", "bucket", F.explode(to).alias("to")).select("id", "c", F.xxhash64("bucket", "to.kind", "to.i", "to.j").alias("task"))
    full = rows.join(feats.select("id", "items"), "id").select("task", "id", "c", "items")
    return full.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(released(_blocks(percent)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = K, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text), one row for each row.

    Documents with 100 * |intersection| >= percent * |union| of their word-k-gram sets are linked; a component
    is what links reach. Equal sets form a class that its smallest doc_id stands for, so copies are never paired.
    Classes that share a band meet in a bucket. First each is compared with the smallest class of its bucket,
    by signature and then by full sets, which connects nearly all that belongs together. Where a bucket then
    still holds several components, their members are compared in blocks of bounded size by full sets. So
    every pair that shares a bucket is compared or connected already, no bucket is gathered whole, and no
    pairs but links leave a task. At 85 % a link escapes all 30 bands of 6 with probability 7e-7 (the
    percentage must not go far below 80 without other bands).

    Null or wordless texts have no shingles and stay alone, with their own id as component. A null doc_id stays
    alone too: component null, kept true. Rows that repeat a doc_id are judged row by row. Ties go to the smaller
    id. An empty table gives an empty one. Further columns are ignored.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark)
    src = only(docs, "doc_id", "text")
    rows = ws.save(src.mapInArrow(_banded(k), "doc_id long, n long, key binary, bands array<long>"), "bands")
    # A class goes by the hash of its set's 128-bit key: repeated doc_ids then cannot merge different sets.
    known = rows.where("key is not null").withColumn("id", F.xxhash64("key"))
    classes = known.groupBy("id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")).where("rep is not null")
    flat = classes.select("id", "rep", "n", F.explode("bands").alias("bucket"))
    shared = flat.groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor("id").alias("x"), F.bit_xor(F.xxhash64("id")).alias("y")).where("low != high")
    # Buckets with the same members, as of most groups in several bands, count once.
    alone = shared.groupBy("m", "low", "high", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    left = ws.save(flat.join(alone, "bucket"), "shared")
    reps = left.select(F.col("rep").alias("doc_id")).distinct()
    sets = squeezed(src.where("text is not null")).join(reps, "doc_id", "left_semi").mapInArrow(_featured(k), "key binary, sig binary, items array<long>")
    feats = ws.save(sets.where("key is not null").select(F.xxhash64("key").alias("id"), "sig", "items").dropDuplicates(["id"]), "features")

    head = left.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("head"))
    pairs = left.join(head, "bucket").where("id != head.id").where(100 * F.least("n", "head.n") >= percent * F.greatest("n", "head.n")).select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct()
    star = ws.save(_links(pairs, feats, percent), "star")
    comp = ws.save(components(star, ws), "components")
    more = ws.save(_mixed(left, feats, comp, percent), "more")
    ws.drop(left, feats)
    if not more.isEmpty():
        # An end of a new link stands for its component: star links and new ones make one graph.
        comp = ws.save(components(star.unionAll(more), ws), "components")

    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.xxhash64("key")).alias("id"), "key")
    grouped = out.join(comp, "id", "left").withColumn("c", F.when(F.col("key").isNotNull(), F.coalesce("component", "id")))
    grouped = grouped.select("doc_id", "n_shingles", "c")
    least = grouped.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("low"))
    named = grouped.join(least, "c", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the whole documents table at 85 %."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


#: The pipeline drops near copies from a similarity of 0.8 on.
STAGE_PERCENT = 80


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near-duplicates; the documents kept stay as they are.

    At a similarity of exactly 80 % a link is missed with probability 1e-4. Rows with a null doc_id, and all
    rows of a kept doc_id, stay; null and wordless texts are nobody's copies. Further columns may have any name;
    an empty table gives an empty one.
    """
    found = near_duplicates(docs, percent=STAGE_PERCENT).where("kept and doc_id is not null").select(F.col("doc_id").alias("of")).distinct()
    inner, doc = numbered(docs), F.col(place(docs, "doc_id"))
    return inner.where(doc.isNotNull()).join(found, doc == F.col("of"), "left_semi").unionAll(inner.where(doc.isNull())).toDF(*docs.columns)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS s FROM w
), flat AS (
  SELECT doc_id, unnest(s) AS x FROM sets
), near AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM near JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n_both >= 85 * (len(p.s) + len(q.s) - n_both)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(d, r) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.d, edges.b FROM reach JOIN edges ON edges.a = reach.r
), low AS (
  SELECT d, min(r) AS component_id FROM reach GROUP BY d
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN low ON low.d = sets.doc_id
"""
