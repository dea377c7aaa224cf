"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import batches, only

#: (verdict, host and path), the longest fitting rule wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: So many rule-labelled URLs are expected in the fit, whatever the table's size; so many suffixes are remembered.
SAMPLE_URLS, SUFFIXES = 30_000, 5_000
TREES, DEPTH, RATE, BINS, LAMBDA = 40, 4, 0.2, 32, 1.0
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.expr("substring(_url, locate('://', _url) + 3)")), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), AZ, az), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and starts the path; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _suffixes(host: str, path: str) -> tuple[str, str, str, str]:
    labels = host.split(".")
    end = re.search(r"\.(\w{1,8})$", path)
    return labels[-1], "." + ".".join(labels[-2:]), "/" + path[1:].split("/")[0][:40], "*" + (end[1] if end else "")


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """Length, depth, digit ratio, entropy, parameters and further counts of a URL; zeros for a null one."""
    u = url or ""
    n = len(u)
    tally = Counter(u)
    query = u.partition("?")[2].partition("#")[0]
    return [
        n, len(host), len(path), path.count("/"), sum(c.isdigit() for c in u) / max(n, 1),
        -sum(c / n * math.log2(c / n) for c in tally.values()) if n else 0.0, len(query.split("&")) if query else 0,
        host.count("."), host.count("-") + path.count("-"), u.startswith("https"), "#" in u, len(re.sub(r"\D", "", path)), int((re.findall(r"\d", path) or ["-1"])[0]),
    ]


@dataclass
class Trees:
    """Boosted trees as arrays: feature (-1 for a leaf), threshold and value by node; children of i are 2i+1, 2i+2."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, t, v in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                right = x[np.arange(len(x)), np.maximum(f[at], 0)] > t[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += v[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the log loss over histograms of BINS quantiles a feature."""
    if not len(x) or y.min() == y.max():
        return Trees(0.0 if not len(x) else (4.0 if y[0] else -4.0), [])
    p = y.mean()
    model = Trees(float(np.log(p / (1 - p))), [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(x), model.base)
    size = 2 ** (DEPTH + 1) - 1
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        f, t, v = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = np.zeros(len(x), np.int64)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            v[node] = -RATE * gs / (hs + LAMBDA)
            if node >= size // 2:
                continue
            best = (1e-6, None)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl = np.cumsum(np.bincount(b, g[rows], BINS + 1))[: len(e)], np.cumsum(np.bincount(b, h[rows], BINS + 1))[: len(e)]
                gain = gl**2 / (hl + LAMBDA) + (gs - gl) ** 2 / (hs - hl + LAMBDA) - gs**2 / (hs + LAMBDA)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-12:
                    best = (gain[k], (j, k))
            if best[1] is not None:
                j, k = best[1]
                f[node], t[node] = j, edges[j][k]
                at[rows] = 2 * node + 1 + (binned[rows, j] > k)
        model.trees.append((f, t, v))
        margin += v[at]
    return model


class Judge:
    """Suffix statistics and trees, learned from labelled (url, host, path, block) rows."""

    def __init__(self, rows: list[tuple[str | None, str, str, bool]]):
        seen, bad = Counter(), Counter()
        for _, host, path, block in rows:
            for s in _suffixes(host, path):
                seen[s] += 1
                bad[s] += block
        self.prior = sum(r[3] for r in rows) / max(1, len(rows))
        self.rates = {s: (bad[s] + 5 * self.prior) / (n + 5) for s, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:SUFFIXES]}
        self.model = boost(self.features([r[:3] for r in rows]), np.array([float(r[3]) for r in rows]))

    def features(self, urls: list[tuple[str | None, str, str]]) -> np.ndarray:
        return np.array([lexical(*u) + [self.rates.get(s, self.prior) for s in _suffixes(u[1], u[2])] for u in urls], np.float64).reshape(len(urls), 17)

    def __call__(self, urls: list[tuple[str | None, str, str]]) -> np.ndarray:
        return self.model.probability(self.features(urls)) if urls else np.zeros(0)


def judge_urls(pages: DataFrame, rules=RULES, sample_urls: int = SAMPLE_URLS) -> DataFrame:
    """(page_id, url) to (page_id, host, path, rule, verdict, score), one row for each row.

    URLs that a rule fits get its verdict; the others that of boosted trees (block from probability 0.5 on),
    which learn from the different URLs that rules label, of which a hash picks about ``sample_urls``.
    score: that probability, null where a rule decides. Null URLs and ones without '://' have an empty host and
    path and are judged by the trees. Without labelled URLs, or with one verdict alone among them, the trees
    say allow, or that verdict. Repeated rows are judged each; an empty table gives an empty one; further
    columns are ignored.
    """
    spark = pages.sparkSession
    src = only(pages, "page_id", "url").select("page_id", F.col("url").alias("_url"))
    host, path = host_path(F.col("_url"))
    src = src.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    src = src.withColumn("rule", rule).withColumn("_ruled", verdict)
    # Different URLs, so that one which a million pages share is one row of the fit.
    labelled = src.where("rule is not null").select("_url", "host", "path", (F.col("_ruled") == "block").alias("block")).distinct()
    known = labelled.agg(F.approx_count_distinct("_url")).first()[0]
    part = min(1.0, sample_urls / max(1, known))
    rows = labelled.where(F.pmod(F.xxhash64("_url"), F.lit(1 << 20)) < part * (1 << 20)).toArrow().to_pylist()
    judge = spark.sparkContext.broadcast(Judge(sorted((tuple(r.values()) for r in rows), key=str)))

    def run(it):
        def one(b):
            ruled = b.column(5).to_pylist()
            urls = list(zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
            open_ = [i for i, r in enumerate(ruled) if r is None]
            score: list[float | None] = [None] * len(urls)
            for i, p in zip(open_, judge.value([urls[i] for i in open_]).tolist(), strict=True):
                score[i], ruled[i] = p, "block" if p >= 0.5 else "allow"
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(ruled, pa.string()), pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

        yield from batches(one)(it)

    return src.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
