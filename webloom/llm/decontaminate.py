"""Benchmark decontamination by greedy string tiling over shared five-word seeds."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import U, WordHashes, batches, numbered, only, place, shingles

WORD = re.compile(r"\w+")
K, COVERAGE = 5, 0.8
#: Items and bytes of them that are broadcast at once; a larger benchmark takes several blocks, each against all documents.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20


def tokens(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for w in WORD.findall(text.lower())] if text else []


ODD = 0x9E3779B97F4A7C15


class _Side:
    """Ids of one side with Karp-Rabin hashes of all runs of a length, from running sums; marked ids are in no run."""

    def __init__(self, ids: np.ndarray, marked: np.ndarray):
        n = len(ids)
        self.ids, self.marked = ids, marked.copy()
        up = np.multiply.accumulate(np.full(n, ODD, np.uint64)) if n else np.zeros(0, np.uint64)
        self.down = np.multiply.accumulate(np.full(n + 1, pow(ODD, -1, 1 << 64), np.uint64))
        self.sums = np.append(U(0), np.cumsum(ids * up))
        self.taken()

    def taken(self) -> None:
        self.before = np.append(0, np.cumsum(self.marked))

    def runs(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the runs of s unmarked ids."""
        n = len(self.ids) - s + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.before[s:] == self.before[:n])
        return at, (self.sums[at + s] - self.sums[at]) * self.down[at]

    def free(self, at: int, s: int) -> bool:
        """Of a run that was unmarked when tiles of s or more began to be marked: such a tile covers one of its ends."""
        return not (self.marked[at] or self.marked[at + s - 1])


def tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(pattern start, text start, length): greedy string tiling of two sequences of ids.

    Again and again the longest match of unmarked ids is marked, down to ``least``; of equally long ones the first
    in the pattern, then in the text. Ids are positive; 0 in the text is a gap that matches nothing. The longest
    length is found by bisection over runs hashed by running sums, and all matches of that length are marked in one
    pass before shorter ones are looked for: what is left of a longer match that overlaps them is shorter and is
    found then. No pairs of places are kept, so repetitive sequences cost no more than others. Equal hashes are
    compared id by id.
    """
    pattern, text = np.asarray(pattern, np.uint64), np.asarray(text, np.uint64)
    p, t = _Side(pattern, np.zeros(len(pattern), bool)), _Side(text, text == 0)
    out, top = [], min(len(pattern), len(text))
    while top >= least:
        common = lambda s: bool(np.isin(p.runs(s)[1], t.runs(s)[1]).any())
        low, high = least - 1, top  # a common run of low ids there is, or low is too short to count
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        if low < least:
            break
        (at_p, h_p), (at_t, h_t) = p.runs(low), t.runs(low)
        keep_p, keep_t = np.isin(h_p, h_t), np.isin(h_t, h_p)
        places = defaultdict(list)
        for h, j in zip(h_t[keep_t][::-1].tolist(), at_t[keep_t][::-1].tolist(), strict=True):
            places[h].append(j)  # the first in the text is the last in the list
        for i, h in zip(at_p[keep_p].tolist(), h_p[keep_p].tolist(), strict=True):
            own, other = places[h], []
            while own and p.free(i, low):
                j = own.pop()
                if not t.free(j, low):
                    continue
                if not np.array_equal(pattern[i : i + low], text[j : j + low]):
                    other.append(j)
                    continue
                p.marked[i : i + low], t.marked[j : j + low] = True, True
                out.append((i, j, low))
            own += other[::-1]
        p.taken()
        t.taken()
        top = low - 1
    return out


class Block:
    """Items of a benchmark with the places of their seeds, the runs of k words (all words of a shorter item)."""

    def __init__(self, items: list[tuple[int, str | None]], k: int = K):
        cache, self.items, self.seeds = WordHashes(), [], {}
        found: dict[int, list] = defaultdict(list)
        for item_id, text in items:
            if not (ws := tokens(text)) or item_id is None:
                continue
            h, n = cache.array(ws), min(k, len(ws))
            s = shingles(h, n)
            found[n].append((s, np.full(len(s), len(self.items)), np.arange(len(s))))
            self.items.append((item_id, h, n))
        for n, parts in found.items():
            s, item, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(s, kind="stable")
            keys, first = np.unique(s[order], return_index=True)
            self.seeds[n] = keys, np.append(first, len(s)), item[order], place[order]

    def shared(self, h: np.ndarray):
        """(item, places of its seeds in the text, length of a seed) of items whose seeds in the text cover enough of them."""
        for n, (keys, first, items, places) in self.seeds.items():
            if len(h) < n:
                continue
            s = shingles(h, n)
            i = np.searchsorted(keys, s)
            i[i == len(keys)] = 0
            at = np.flatnonzero(keys[i] == s)
            if not len(at):
                continue
            seed, to = np.unique(i[at], return_inverse=True)
            # One row for each seed of an item, however often the text has it.
            count = first[seed + 1] - first[seed]
            row = np.repeat(first[seed] - np.cumsum(count) + count, count) + np.arange(count.sum())
            item, place = items[row], places[row]
            order = np.lexsort((place, item))
            item, place = item[order], place[order]
            new = np.append(True, item[1:] != item[:-1])
            covered = np.minimum(np.where(np.append(new[1:], True), n, np.append(np.diff(place), n)), n)
            total = np.add.reduceat(covered, np.flatnonzero(new))
            of = np.repeat(np.arange(len(seed)), count)[order]
            begin = np.append(np.flatnonzero(new), len(item))
            for k, (a, z) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                yield int(item[a]), int(total[k]), lambda a=a, z=z, at=at, to=to, of=of: at[np.isin(to, of[a:z])], n

    def best(self, text: str | None, cache: WordHashes, coverage: float) -> tuple[int, float] | None:
        """The item of the largest coverage from the threshold on; of equal ones the smallest id."""
        ws = tokens(text)
        if not ws:
            return None
        h, out = cache.array(ws), None
        for item, reach, where, n in self.shared(h):
            item_id, pattern, _ = self.items[item]
            if reach < coverage * len(pattern):
                continue
            # Every match is a row of seeds, so the rest of the text can be left out; a gap keeps pieces apart.
            at = where()
            keep = np.zeros(len(h) + 1, bool)
            for j in range(n):
                keep[at + j] = True
            ids = np.where(keep, np.append(h, U(0)), U(0))
            piece = ids[keep | np.append(True, keep[:-1])]
            share = sum(m for _, _, m in tiles(pattern, piece, n)) / len(pattern)
            if share >= coverage and (out is None or (-share, item_id) < (-out[1], out[0])):
                out = item_id, share
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of docs with item_id and coverage: the benchmark item that a document holds most of.

    An item is held if non-overlapping word tiles of five words or more, in any order, cover at least
    ``coverage`` of its words; an item of fewer than five words must appear whole. Words are runs of letters,
    digits and underscores, lower-cased. Documents that hold none get nulls, as do null and empty texts.
    Null or wordless items are held by none; repeated items count once each; of equal coverages the smallest
    item_id is named. Rows of docs are answered one by one, so repeats and null ids stay. With an empty
    benchmark all get nulls. Large benchmarks are taken in blocks, dealt by a hash of the item, of about BLOCK_ITEMS
    items or BLOCK_BYTES bytes; each is a broadcast. Further columns may have any name.
    """
    found = _contaminated(docs, benchmark, coverage)
    return found.select(*(F.col(place(docs, c)).alias(c) for c in keep), F.col("item").alias("item_id"), F.when(F.col("item").isNotNull(), F.col("share")).alias("coverage"))


def _contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """numbered(docs) with item and share."""
    spark = docs.sparkSession
    items = only(benchmark, "item_id", "text").where("item_id is not null and text is not null").distinct()
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    out = numbered(docs).select("*", F.lit(None).cast("long").alias("item"), F.lit(0.0).alias("share"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])
    at, n = docs.columns.index("text"), len(docs.columns)
    for k in range(blocks):
        held = spark.sparkContext.broadcast(Block([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]))

        def run(it, held=held):
            cache = WordHashes()

            def one(b):
                item, share = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
                for i, t in enumerate(b.column(at).to_pylist()):
                    if (got := held.value.best(t, cache, coverage)) and (item[i] is None or (-got[1], got[0]) < (-share[i], item[i])):
                        item[i], share[i] = got
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(item, pa.int64()), pa.array(share, pa.float64())], names=schema.names)

            yield from batches(one)(it)

        out = out.mapInArrow(run, schema)
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark item it leaks, if any: doc_id, contaminated, item_id, coverage."""
    found = contamination(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "coverage")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; the others stay as they are, null and empty texts among them.

    Repeated rows are judged each, further columns may have any name, and an empty table gives an empty one.
    """
    found = _contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COVERAGE)
    return found.where("item is null").drop("item", "share").toDF(*docs.columns)
