"""Media columns: AVI files in, timed clip rows out; texts as lossless motion-JPEG payloads."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import avi
from .text import batches, only


def clips(videos: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, clip, start_s, end_s, frames, motion, error): one row for each shot of each AVI file in ``column``.

    A null or empty file, or one without frames, has no clip; a broken file has one row with the error and
    nulls. Frames must be baseline JPEG of one size, grey or in colour, of which the brightness counts. Further columns are ignored; an empty table gives an empty one.
    """
    kind = videos.schema[key].dataType.simpleString()

    def run(it):
        def one(b):
            rows = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    frames, fps, _ = avi.read(data) if data else ([], 0.0, None)
                    if not frames:
                        continue
                    fps = fps or 1.0
                    try:
                        own = avi.coefficients(frames) if all(f.startswith(avi.HEAD) for f in frames) else None
                    except ValueError:
                        own = None
                    if own is None:
                        parts = [avi.decode(f) for f in frames]
                        own = np.stack([c * q for c, q, _, _ in parts])
                    found = avi.shots(avi.histograms(own))
                    rows += [(k, i, a / fps, z / fps, z - a, round(m, 6), None) for i, (a, z, m) in enumerate(found)]
                except Exception as e:  # noqa: BLE001  whatever a broken file causes is its row's error
                    rows.append((k, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [b.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "clip", "start_s", "end_s", "frames", "motion", "error"])

        yield from batches(one)(it)

    return only(videos, key, column).mapInArrow(run, f"`{key}` {kind}, clip long, start_s double, end_s double, frames long, motion double, error string")


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def digest(text: str | None) -> tuple:
    """(n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of a text stored as AVI."""
    raw, n = padded(text)
    data = avi.write(raw)
    frames, fps, length = avi.read(data)
    coefs = avi.coefficients(frames)
    back = avi.BYTE[coefs + 128].tobytes()[:length]
    found = avi.shots(avi.histograms(coefs))
    feature = f"frames={len(frames)};clips={len(found)};cuts=" + ",".join(f"{a / fps:.2f}" for a, _, _ in found[1:])
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to what digest() says of each row's whole text; a null text is empty. Rows stay one by one."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(it):
        def one(b):
            cols = zip(*(digest(t) for t in b.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *names])

        yield from batches(one)(it)

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as AVI motion JPEG and read back."""
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
