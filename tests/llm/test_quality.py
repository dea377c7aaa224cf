import random
import zlib

import numpy as np

from webloom.llm.quality import isotonic, quality_scores, statistics


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(500):
        good = r.random() < 0.75
        t = " ".join(word() for _ in range(60)) + "." if good else (word().upper() + "!! ") * 40
        rows.append((i, t))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    rows += [(900, None), (901, ""), (None, "some words here"), (3, "short"), (902, "word " * 200_000)]
    docs = spark.createDataFrame([(d, t, 1.0, 2) for d, t in rows], "doc_id long, text string, score double, x int")
    known = spark.createDataFrame(labels + [(901, None), (7777, 1)], "doc_id long, quality int")
    got = quality_scores(docs, known).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got if g.doc_id != 3}
    held = [(by[d], q) for d, q in labels if d in by and by[d].held_out]
    assert len(held) > 60 and sum(g.predicted == q for g, q in held) >= 0.97 * len(held)
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    assert by[900].score == by[901].score and not by[None].held_out


def test_isotonic_is_monotone_and_keeps_the_mean():
    r = np.random.default_rng(3)
    n = r.integers(0, 20, 64)
    ones = r.binomial(n, np.linspace(0.1, 0.9, 64))
    at, value = isotonic(np.arange(64), ones, n)
    assert (np.diff(value) >= 0).all()
    fitted = value[np.searchsorted(at, np.arange(64), "right") - 1]
    assert np.isclose((fitted * n).sum(), ones.sum())


def test_without_labels_and_empty(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert [(x.score, x.predicted) for x in quality_scores(docs, none).collect()] == [(0.5, 1)]
    assert quality_scores(docs.where("false"), none).collect() == []
    assert len(statistics("a b c")) == len(statistics(None)) == 14


def test_scores_equal_plain_normal_equations(spark):
    """The whole query against matrices of all labelled rows at once, and the isotonic fit by its minimax formula."""
    rows, labels = corpus()
    r = random.Random(1)
    labels = [(d, q if r.random() < 0.9 else 1 - q) for d, q in labels]
    got = {g.doc_id: g for g in quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.array([statistics(t) for _, t in rows], np.float32).astype(float)
    known = np.array([zlib.crc32(str(d).encode()) % 5 != 0 for d, _ in rows])
    assert all(got[d].held_out != k for (d, _), k in zip(rows, known, strict=True))
    y = np.array([q for _, q in labels], float)[known]
    g = np.random.Generator(np.random.PCG64(7))
    sd = x[known].std(axis=0)
    w, b = g.normal(0, 1 / 2, (14, 256)), g.uniform(0, 2 * np.pi, 256)
    z = np.sqrt(2 / 256) * np.cos(np.clip((x - x[known].mean(axis=0)) / np.where(sd > 1e-9, sd, 1), -6, 6) @ w + b)
    z = np.hstack([z, np.ones((len(z), 1))])
    penalty = 1e-3 * known.sum() / 256 * np.diag([1.0] * 256 + [0.0])
    raw = z @ np.linalg.solve(z[known].T @ z[known] + penalty, z[known].T @ y)
    at = np.clip((raw + 0.5) / 2 * 512, 0, 511).astype(int)
    have = sorted(set(at[known].tolist()))
    n, ones = np.array([(at[known] == k).sum() for k in have]), np.array([y[at[known] == k].sum() for k in have])
    mean = lambda i, j: ones[i : j + 1].sum() / n[i : j + 1].sum()
    fitted = [max(min(mean(i, j) for j in range(k, len(have))) for i in range(k + 1)) for k in range(len(have))]
    want = np.array(fitted)[np.clip(np.searchsorted(have, at, "right") - 1, 0, None)]
    same = np.isclose([got[d].score for d, _ in rows], want)
    assert same.mean() > 0.98 and len(have) > 20  # a raw score on the edge of a bin may fall to either side
