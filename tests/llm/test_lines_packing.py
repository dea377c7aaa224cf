import itertools
import random
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from webloom.llm.line_dedup import OP3_SQL, line_stage, remove_boilerplate
from webloom.llm.packing import OP2_SQL, boundaries, op2_packing, pack

COLS = "doc_id long, text string, source string"


def lines_corpus():
    r = random.Random(2)
    rows = []
    for i in range(300):
        own = [f"line {r.randrange(10**6)}" for _ in range(r.randint(0, 4))]
        for k in range(8):
            if r.random() < 0.05 + 0.03 * k:
                own.insert(r.randint(0, len(own)), f"shared {k}" if r.random() < 0.9 else "")
        rows.append((i, "\n".join(own), f"s{r.randrange(12)}" if k else None))
    return rows + [(900, None, "s1"), (901, "", "s1"), (902, "shared 7\n" * 3, "s2"), (903, "shared 7", None), (904, "   \n   ", "s3")]


def test_same_as_sql(spark):
    rows = lines_corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_removed, text FROM ({OP3_SQL})").fetchall())
    df = spark.createDataFrame([(*x, 5, "k") for x in rows], COLS + ", pos int, line string")
    got = sorted((x.doc_id, x.n_lines, x.n_removed, x.text) for x in remove_boilerplate(df).collect())
    assert got == want and sum(x[2] for x in got) > 50


def test_hot_line_null_and_repeated_ids(spark):
    rows = [(i, f"body {i}\ncommon", f"s{i % 40}") for i in range(400)] + [(None, "common\nx", "s1"), (5, "common\nother", "s1"), (5, "common\nother", "s1")]
    got = remove_boilerplate(spark.createDataFrame(rows, COLS)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for g in got:
        by[g.doc_id].append(g.text)
    assert by[0] == ["body 0\ncommon"] and by[7] == ["body 7"] and by[None] == ["common\nx"] and sorted(by[5]) == ["body 5", "other", "other"]
    assert remove_boilerplate(spark.createDataFrame([], COLS)).collect() == []


def test_boundaries_are_optimal():
    r = np.random.default_rng(1)
    for _ in range(30):
        n = int(r.integers(1, 9))
        lengths, counts = np.sort(r.choice(60, n, replace=False)) + 1, r.integers(1, 9, n)
        k = int(r.integers(1, 5))
        cost = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))
        best = min(cost([*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], m))
        ends = boundaries(lengths, counts, k)
        assert len(ends) <= k and cost(ends) == best


def test_batches(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(int(r.expovariate(0.02))))) for i in range(700)] + [(800, None), (801, ""), (802, "x " * 70_000), (None, "a b"), (5, "a b c"), (5, "a b c")]
    got = pack(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int"), buckets=6, budget=400).collect()
    assert len(got) == len(rows)
    assert all(g.n_tokens <= g.bucket for g in got) and len({g.bucket for g in got}) <= 6
    cells = defaultdict(lambda: defaultdict(list))
    for g in got:
        cells[g.bucket][g.batch].append(g.slot)
    for b, batches in cells.items():
        room = max(1, 400 // b)
        assert sorted(batches) == list(range(len(batches)))
        assert all(sorted(s) == list(range(room)) for k, s in batches.items() if k < len(batches) - 1)
        assert sorted(batches[len(batches) - 1]) == list(range(len(batches[len(batches) - 1])))
    assert {g.n_tokens for g in got if g.doc_id in (800, 801)} == {1}
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_lengths_are_told_apart():
    """Thousands of lengths above 1024: the same padding as the quadratic programme over all of them."""
    r = np.random.default_rng(4)
    lengths, counts = np.sort(r.choice(100_000, 700, replace=False)) + 1, r.integers(1, 50, 700)
    c, s = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))
    best = np.append(0, np.full(700, np.iinfo(np.int64).max // 4))
    for _ in range(9):
        best = np.array([0] + [min(best[i] + lengths[j - 1] * (c[j] - c[i]) - (s[j] - s[i]) for i in range(j)) for j in range(1, 701)])
    ends = np.array(boundaries(lengths, counts, 9))
    assert (counts * (ends[np.searchsorted(ends, lengths)] - lengths)).sum() == best[-1]


def test_packing_same_as_sql(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(int(r.expovariate(0.0008))))) for i in range(400)] + [(800, None), (801, ""), (802, " \t\u00a0x "), (5, "a b c"), (5, "a b c"), (5, "a b"), (803, "x " * 70_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_tokens, bucket, batch, slot FROM ({OP2_SQL})").fetchall())
    assert sorted(tuple(x) for x in op2_packing(spark, str(tmp_path)).collect()) == want and len({x[2] for x in want}) == 16


def test_ends_are_true_lengths(spark):
    """Above 1024 too the longest row of a bucket is as long as the bucket."""
    sizes = [5, 9, 1024, 1100, 1101, 1500, 2047, 3001, 3002, 9999]
    got = pack(spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string"), buckets=4).collect()
    most = defaultdict(int)
    for g in got:
        most[g.bucket] = max(most[g.bucket], g.n_tokens)
    assert len(got) == len(sizes) and len(most) == 4 and all(b == n for b, n in most.items())


def test_sketches_decide_away_from_the_threshold(spark, monkeypatch):
    """Far above the threshold the sketch's word counts: no exact count gates it."""
    docs = spark.createDataFrame([(i, f"body {i}\ncommon", f"s{i % 3}") for i in range(40)], COLS)
    assert all(x.n_removed == 0 for x in remove_boilerplate(docs).collect())
    monkeypatch.setattr("webloom.llm.line_dedup.F.hll_sketch_estimate", lambda c: F.lit(1000.0))
    assert sum(x.n_removed for x in remove_boilerplate(docs).collect()) == 39


def test_line_stage_keeps_columns_of_any_name(spark):
    rows = [(i, f"body {i}\ncommon" if i < 30 else "common", f"s{i % 20}", 1, "t", 5, 6, "k") for i in range(40)] + [(90, None, "s", None, "t", 5, 6, "k"), (91, "", "s", 0, "t", 5, 6, "k")]
    docs = spark.createDataFrame(rows, COLS + ", n_chars long, _text string, _n_removed int, `a.b` int, line string")
    got = line_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars, r._text, r["a.b"]) for r in got.collect()} == {0: ("body 0\ncommon", 1, "t", 6), 90: (None, None, "t", 6), 91: ("", 0, "t", 6)} | {i: (f"body {i}", len(f"body {i}"), "t", 6) for i in range(1, 30)}
    assert line_stage(spark, docs.where("false"), "").collect() == []
