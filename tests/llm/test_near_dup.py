import random

import numpy as np
import pytest

from webloom.llm.near_dup import near_dup_stage, near_duplicates
from webloom.llm.text import words


def brute(rows, percent=85):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)], low[find(i)] == d) for i, (d, _) in enumerate(rows)}


def corpus(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, nxt = [], 0
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(3, 120))]
        for _ in range(r.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((nxt, " ".join(t)))
            nxt += 1
    # a chain: each step changes one word, so that only neighbours are linked
    t = [r.choice(vocab) for _ in range(100)]
    for i in range(12):
        rows.append((nxt, "\n".join(t)))
        nxt += 1
        t[5 + 7 * i] = f"x{i}"
    r.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, "  \n"), (1003, "One two"), (1004, "one\ttwo"), (1005, "a b\xa0c"), (1006, "A B\xa0C")]
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert got[1004][1] == 1003 and got[1006][1] == 1005


def test_large_group_long_text_nulls_repeats_and_clashing_columns(spark):
    r = random.Random(5)
    base = [f"v{r.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(200):
        t = list(base)
        t[r.randrange(150)] = f"u{i}"
        rows.append((i, " ".join(t)))
    long = " ".join(f"q{i}" for i in range(60_000))
    rows += [(500, long), (501, long), (502, long), (502, long), (None, long)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, n long")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert all(by[i].component_id == 0 and by[i].kept == (i == 0) for i in range(200))
    assert by[501].component_id == by[502].component_id == 500 and by[500].kept and by[500].n_shingles == 59_996
    assert by[None].component_id is None and by[None].kept
    assert sum(x.doc_id == 502 for x in got) == 2


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stage_keeps_columns_of_any_name(spark):
    rows = [(i, f"one two three four five six {i // 2}", "s", i) for i in range(6)] + [(None, "one two three four five six 0", "s", 7), (9, None, "s", 8), (10, "", "s", 9), (0, "one two three four five six 0", "s", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc string, `a.b` int")
    got = near_dup_stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(r["a.b"] for r in got.collect()) == [0, 2, 4, 7, 8, 9, 10]
    assert near_dup_stage(spark, docs.where("false"), "").collect() == []
