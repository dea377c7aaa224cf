"""Exact removal of repeated 50-byte strings: minimiser anchors find them, bucket-pointer refinement decides.

Two equal strings of SPAN bytes choose the same q-gram, their minimiser, so they meet under its hash. Which of the
strings around an anchor are equal is found by sorting: buckets of 8-grams are refined by the bucket numbers at later
offsets, and numbers refined so far are used again at once, which doubles the depth each time.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import M1, M2, U, mixed, only, released, squeezed, unsqueezed
from .work import Workspace

SPAN, Q = 50, 20
#: Texts are cut into pieces of so many bytes for hashing, overlapping by SPAN - 1: positions fit 24 bits.
PIECE = 1 << 22
#: Segments that one refinement task sorts at once; groups of more are not sorted but told apart by digests.
TASK_SEGMENTS, SALTS = 5_000, 8
#: Bytes of texts whose anchors are held at once.
CHUNK = 8 << 20


def _gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams of bytes, by doubling."""
    n = len(x) - q + 1
    h, acc, off, k = x.astype(np.uint64) * M1 + U(1), None, 0, 1
    while True:
        if q & 1:
            part = h[off : off + n]
            acc = part.copy() if acc is None else (acc * M2) ^ part
            off += k
        q >>= 1
        if not q:
            return mixed(acc)
        h = h[:-k] * M2 + h[k:]
        h ^= h >> U(29)
        k *= 2


def anchors(raw: bytes, span: int = SPAN, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first start, last start): each minimiser and the span-byte strings whose minimiser it is.

    Every start of such a string is in exactly one range. Of equal hashes in a string the leftmost counts, which
    equal strings agree on.
    """
    out = []
    for at in range(0, max(1, len(raw) - span + 1), PIECE):
        x = np.frombuffer(raw[at : at + PIECE + span - 1], np.uint8)
        if len(x) < span:
            break
        h = _gram_hashes(x, q)
        m, k, w = (h & ~U(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), 1, span - q + 1
        while k * 2 <= w:
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        if k < w:
            m = np.minimum(m[: len(m) - (w - k)], m[w - k :])
        pos = (m & U(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
        last = np.append(first[1:], len(pos)) - 1
        out.append((h[pos[first]], pos[first] + at, first + at, last + at))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def refine(text: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Bucket numbers of the span-byte strings at ``starts`` (each inside ``text``): equal if and only if they are.

    Bucket-pointer refinement. All positions begin in buckets of their first 8 bytes. A bucket of several is
    sorted by the bucket pointers at offset d, where the pointers tell strings of d bytes apart, so that they
    tell 2d after; since the pass updates the pointers that later passes read, each level reuses the levels
    before. Alone in its bucket, a position is done. The last pass overlaps, so that exactly span bytes count.
    """
    n = len(text)
    pad = np.zeros(n + 8, np.uint64)
    pad[:n] = text
    key = pad[:n].copy()
    for j in range(1, 8):
        key = (key << U(8)) | pad[j : n + j]
    d = min(8, span)
    if d < 8:
        key >>= U(8 * (8 - d))
    pointer = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while d < span:
        step = min(d, span - d)
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = pointer[step:]
        size = np.bincount(pointer)
        open_ = np.flatnonzero(size[pointer] > 1)
        order = open_[np.lexsort((ahead[open_], pointer[open_]))]
        p, a = pointer[order], ahead[order]
        new = np.append(True, (p[1:] != p[:-1]) | (a[1:] != a[:-1])) if len(order) else np.zeros(0, bool)
        # Numbers of split buckets follow all others; singletons keep theirs.
        pointer[order] = len(size) + np.cumsum(new) - 1
        pointer = np.unique(pointer, return_inverse=True)[1]
        d += step
    return pointer[starts]


def later_strings(segments: list[bytes], docs: np.ndarray, group: np.ndarray, span: int = SPAN) -> list[tuple[int, int, int]]:
    """(segment, first, last): the runs of span-byte strings in a segment that also start in one of the same group
    with a smaller doc. Groups hold segments with the same anchor; equal strings are in one group only."""
    lens = np.array([len(s) for s in segments])
    ends = np.cumsum(lens)
    base = ends - lens
    counts = np.maximum(lens - span + 1, 0)
    seg = np.repeat(np.arange(len(segments)), counts)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
    rank = refine(np.frombuffer(b"".join(segments), np.uint8), base[seg] + offset, span)
    order = np.lexsort((docs[seg], rank))
    r = rank[order]
    first = np.append(True, r[1:] != r[:-1]) if len(r) else np.zeros(0, bool)
    low = docs[seg[order]][first][np.cumsum(first) - 1] if len(r) else np.zeros(0, np.int64)
    later = np.zeros(len(seg), bool)
    later[order] = docs[seg[order]] > low
    at = np.flatnonzero(later)
    if not len(at):
        return []
    cut = np.append(True, (np.diff(at) > 1) | (seg[at][1:] != seg[at][:-1]))
    a, b = at[cut], at[np.append(cut[1:], True)]
    return list(zip(seg[a].tolist(), offset[a].tolist(), offset[b].tolist(), strict=True))


_POW: dict[str, np.ndarray] = {}
ODD = 0x9E3779B97F4A7C15
ODD_INVERSE = pow(ODD, -1, 1 << 64)


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, remembered."""
    have = _POW.get(name)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        have = _POW[name] = np.concatenate([[U(1)], np.multiply.accumulate(np.full(size - 1, base, np.uint64))])
    return have[:n]


def POWERS(n: int) -> np.ndarray:
    return _powers("up", ODD, n)


def INVERSES(n: int) -> np.ndarray:
    return _powers("down", ODD_INVERSE, n)


def _classes(raw: bytes, span: int) -> tuple[np.ndarray, ...]:
    """(h, around, first, more) of the anchors of a text: 48 bits of the q-gram's hash, 40 of the bytes that the
    anchor's strings cover, the first string and how many follow."""
    h, _, first, last = anchors(raw, span)
    if not len(h):
        return h, h, first, last
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    sums = np.concatenate([[U(0)], np.cumsum((x + U(1)) * POWERS(len(x)))])
    around = mixed((sums[last + span] - sums[first]) * INVERSES(len(x))[first] + (last - first).astype(np.uint64))
    return h & U((1 << 48) - 1), around & U((1 << 40) - 1), first, last - first


def _pack(h, around, doc, first, more) -> bytes:
    """Columns of anchors in few bytes: hashes as they are, the others as compressed differences."""
    low = lambda x, k: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].tobytes()
    rest = b"".join(np.diff(c, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in (doc, first)) + more.astype(np.uint8).tobytes()
    return len(h).to_bytes(8, "little") + low(h, 6) + low(around, 5) + zlib.compress(rest, 1)


def _unpack(blob) -> tuple[np.ndarray, ...]:
    blob = memoryview(blob)
    n = int.from_bytes(blob[:8], "little")
    out, at = [], 8
    for k in (6, 5):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :k] = np.frombuffer(blob, np.uint8, n * k, at).reshape(n, k)
        out.append(wide.reshape(-1).view("<u8"))
        at += n * k
    rest = np.frombuffer(zlib.decompress(blob[at:]), np.uint8)
    for i in range(2):
        out.append(np.cumsum(np.ascontiguousarray(rest[i * 8 * n : (i + 1) * 8 * n].reshape(8, n).T).reshape(-1).view("<i8")))
    return *out, rest[16 * n :].astype(np.int64)


SHIFT = 40  # a position is variant << SHIFT | byte: rows with the same doc_id and other texts are variants


def _anchored(span: int, buckets: int):
    """(doc_id, text, variant) to (bucket, blob): packed anchors by a hash of the q-gram.

    Of a class (equal q-gram and bytes around it) in a chunk, only the rows of the smallest doc_id have yet to
    meet the rest of the corpus; the others are later in any case and go to buckets from ``buckets`` on, dealt
    by chunk. So a passage that a third of the corpus holds weighs as much as one row a chunk.
    """

    def dealt(parts):
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort((cols[2], cols[1], cols[0]))
        h, around, doc = (c[order] for c in cols[:3])
        new = np.append(True, (h[1:] != h[:-1]) | (around[1:] != around[:-1]))
        later = np.zeros(len(h), bool)
        later[order] = doc > doc[new][np.cumsum(new) - 1]
        bucket = np.where(later, buckets + int(cols[2][0]) % buckets, (mixed(cols[0]) % U(buckets)).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        names, at = np.unique(bucket[order], return_index=True)
        ends = np.append(at[1:], len(order))
        blobs = [_pack(*(c[order[a:z]] for c in cols)) for a, z in zip(at, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(it):
        parts, held = [], 0
        for b in it:
            for i, t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                h, around, first, more = _classes(raw, span)
                if len(h):
                    parts.append((h, around, np.full(len(h), i, np.int64), first + (v << SHIFT), more))
                    held += len(raw)
                if held > CHUNK:
                    yield dealt(parts)
                    parts, held = [], 0
        if parts:
            yield dealt(parts)

    return run


def _met(buckets: int):
    """Blobs in the order of buckets to (doc, first, more, h): decided strings (h null) and ones to compare by bytes."""

    def rows(doc, first, more, h=None):
        for i in range(0, len(doc), 50_000):
            z = slice(i, i + 50_000)
            part = pa.nulls(len(doc[z]), pa.int64()) if h is None else pa.array(h[z].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(doc[z]), pa.array(first[z]), pa.array(more[z]), part], names=["doc", "first", "more", "h"])

    def met(open_):
        # Columns are sorted one by one, so that only one is there twice.
        cols = [np.concatenate(c) for c in zip(*open_, strict=True)]
        open_.clear()
        order = np.lexsort((cols[2], cols[1], cols[0]))
        for i, c in enumerate(cols):
            cols[i] = c[order]
        h, around, doc, first, more = cols
        cols.clear()
        gram = np.append(True, h[1:] != h[:-1])
        kind = gram | np.append(True, around[1:] != around[:-1])
        del order, around
        low = doc[kind][np.cumsum(kind) - 1]
        done = doc > low
        yield from rows(doc[done], first[done], more[done])
        at, g = np.flatnonzero(gram), np.cumsum(gram) - 1
        ask = (np.add.reduceat(kind.astype(np.int32), at) > 1) & (np.minimum.reduceat(doc, at) < np.maximum.reduceat(low, at))
        ask = ask[g] & ~done
        yield from rows(doc[ask], first[ask], more[ask], h[ask])

    def run(it):
        bucket, open_ = None, []
        for b in it:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != bucket and open_:
                    yield from met(open_)
                bucket = k
                cols = _unpack(blob.as_buffer())
                if k < buckets:
                    open_.append(cols)
                else:
                    yield from rows(*cols[2:])
        if open_:
            yield from met(open_)

    return run


def _cut(span: int):
    """(doc, text, variant, list of (h, first, more, hot)) to the segments around anchors; of hot anchors to all single
    strings, each by the 128-bit digest of its bytes, with a null h."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(it):
        for b in it:
            out: list[tuple] = []
            cols = [c.to_pylist() for c in b.columns]
            cols[1] = unsqueezed(b.column(1))
            for doc, t, v, hs, firsts, mores, hots in zip(*cols, strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for h, f, m, hot in zip(hs, firsts, mores, hots, strict=True):
                    if f >> SHIFT != v:
                        continue
                    a = f & ((1 << SHIFT) - 1)
                    if hot:
                        out += [(None, doc, f + j, xxhash.xxh3_128_digest(raw[a + j : a + j + span])) for j in range(m + 1)]
                    else:
                        out.append((h, doc, f, raw[a : a + m + span]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "doc", "first", "bytes"])
                    out.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "doc", "first", "bytes"])

    return run


def _shared(strings: DataFrame) -> DataFrame:
    """(doc, first, more) of single strings (doc, first, bytes: their digests) that a smaller doc has too.

    The least doc of each is an aggregate; to meet it, the rows of a string are dealt out by a salt.
    """
    low = strings.groupBy("bytes").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("bytes", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = strings.withColumn("salt", F.pmod(F.xxhash64("doc", "first"), F.lit(SALTS)).cast("int"))
    return dealt.join(low, ["bytes", "salt"]).where("doc > low").select("doc", "first", F.lit(0).cast("long").alias("more"))


def _sorted_out(span: int):
    """Segments in the order of h to decided strings; every group of one h is sorted whole, in one or more at once."""

    def decide(parts):
        h, doc, first = (np.concatenate([p[i] for p in parts]) for i in range(3))
        found = later_strings([s for p in parts for s in p[3]], doc, h, span)
        seg = [x[0] for x in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[seg] if seg else [], pa.int64()), pa.array([int(first[s]) + a for s, a, _ in found], pa.int64()), pa.array([z - a for _, a, z in found], pa.int64())], names=["doc", "first", "more"]
        )

    def run(it):
        parts, n = [], 0
        for b in it:
            if not b.num_rows:
                continue
            h, doc, first = (b.column(i).to_numpy() for i in range(3))
            raw = b.column(3).to_pylist()
            if n > TASK_SEGMENTS:
                start = int(np.argmax(h != parts[-1][0][-1])) if (h != parts[-1][0][-1]).any() else None
                if start is not None:
                    parts.append((h[:start], doc[:start], first[:start], raw[:start]))
                    yield decide(parts)
                    parts, n, h, doc, first, raw = [], 0, h[start:], doc[start:], first[start:], raw[start:]
            parts.append((h, doc, first, raw))
            n += len(h)
        if parts:
            yield decide(parts)

    return run


def _removed(span: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(it):
        for b in it:
            out = []
            cols = [c.to_pylist() for c in b.columns]
            cols[1] = unsqueezed(b.column(1))
            for doc, t, v, firsts, mores in zip(*cols, strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                spans = []
                for f, m in sorted(zip(firsts or (), mores or (), strict=True)):
                    if f >> SHIFT != v:
                        continue
                    a = f & ((1 << SHIFT) - 1)
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], a + m + span)
                    else:
                        spans.append([a, a + m + span])
                kept, at = hashlib.sha256(), 0
                for a, z in spans:
                    kept.update(raw[at:a])
                    at = z
                kept.update(raw[at:])
                out.append((doc, len(raw), sum(z - a for a, z in spans), len(spans), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=names)

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row.

    Of a text's UTF-8 bytes every one goes that is covered by a ``span``-byte string which also starts in a
    document with a smaller doc_id; strings are judged on the input. A null text is empty. Texts under ``span``
    bytes stay whole. Copies of the smallest doc_id's text go entirely. Rows with the same doc_id are one
    document's: none is smaller than the other, and each is judged by its own text. A null doc_id is compared
    with nothing and keeps its text. An empty table gives an empty one; further columns are ignored.
    ``span`` must be at least Q.

    Anchors with the same surroundings are known by 88 bits of two hashes, so that of 10^12 anchors one pair is taken
    for equal wrongly with probability 0.002. Other surroundings are sorted, in groups of one 20-gram each; a 20-gram
    with more than TASK_SEGMENTS of them goes string by string, by 128-bit digests, so that no group is gathered whole.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark)
    src = only(docs, "doc_id", "text")
    hashed = src.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids = hashed.groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("z")).where("a != z").select("doc_id")
    if ids.isEmpty():
        src = src.withColumn("variant", F.lit(0).cast("long"))
    else:
        many = hashed.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("t")).alias("ts"))
        src = src.join(many, "doc_id", "left").select("doc_id", "text", F.coalesce(F.array_position("ts", F.xxhash64("text")) - 1, F.lit(0)).cast("long").alias("variant"))
    live = src.where("doc_id is not null and octet_length(text) >= %d" % span)
    # About a quarter of a million anchors a bucket, four buckets a task.
    buckets = max(8, -(-total // (4 << 20)))
    blobs = live.mapInArrow(released(_anchored(span, buckets)), "bucket long, blob binary")
    met = ws.save(blobs.repartition(-(-buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(released(_met(buckets)), "doc long, first long, more long, h long"), "met")
    open_ = met.where("h is not null")
    # A 20-gram with more different surroundings than one task sorts at once: its strings are told apart one by one.
    hot = ws.save(open_.groupBy("h").count().where(F.col("count") > TASK_SEGMENTS).select("h", F.lit(True).alias("hot")), "hot")
    any_hot = not hot.isEmpty()
    flagged = open_.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if any_hot else open_.withColumn("hot", F.lit(False))
    ask = flagged.groupBy(F.col("doc").alias("doc_id")).agg(*(F.collect_list(c).alias(c) for c in ("h", "first", "more", "hot")))
    segments = squeezed(live).join(ask, "doc_id").select("doc_id", "text", "variant", "h", "first", "more", "hot").mapInArrow(released(_cut(span)), "h long, doc long, first long, bytes binary")
    if any_hot:
        segments = ws.save(segments, "segments")
    cold = segments.where("h is not null") if any_hot else segments
    sorted_ = cold.repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(released(_sorted_out(span)), "doc long, first long, more long")
    decided = ws.save(sorted_.unionAll(_shared(segments.where("h is null").select("doc", "first", "bytes"))) if any_hot else sorted_, "decided")
    decided = decided.unionAll(met.where("h is null").select("doc", "first", "more"))
    out = decided.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("first").alias("first"), F.collect_list("more").alias("more"))
    return squeezed(src).join(out, "doc_id", "left").select("doc_id", "text", "variant", "first", "more").mapInArrow(released(_removed(span)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings of the whole documents table."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
