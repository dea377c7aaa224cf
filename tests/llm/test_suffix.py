import hashlib
import random

import numpy as np

from webloom.llm.suffix import SPAN, anchors, refine, remove_repeats


def brute(rows, span=SPAN):
    first = {}
    for d, t in rows:
        if d is not None:
            raw = (t or "").encode()
            for i in range(len(raw) - span + 1):
                s = raw[i : i + span]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        if d is not None:
            for i in range(len(raw) - span + 1):
                if first[raw[i : i + span]] < d:
                    gone[i : i + span] = [True] * span
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows(seed=3):
    r = random.Random(seed)
    word = lambda: r.choice(["la", "té", "no", "ixi", "a", "ß", "the "])
    text = lambda n: "".join(word() for _ in range(n))
    line = text(40)
    out = [(i, text(r.randint(0, 150))) for i in range(60)]
    for i in range(60, 120):
        base = out[r.randrange(60)][1]
        a = r.randint(0, len(base))
        out.append((i, r.choice([base, base[:a] + "!" + base[a:], text(20) + base[a : a + 60] + text(9), f"{text(15)}\n{line}\n{text(15)}", "ab" * r.randint(10, 90), line + line])))
    out += [(200, None), (201, ""), (None, line), (203, "x" * 49), (204, "x" * 50), (205, "x" * 51), (206, "y" * 200), (207, "x" * 49 + "y" * 60), (7, out[8][1]), (8, out[8][1])]
    r.shuffle(out)
    return out


def test_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, h int")
    assert sorted((tuple(x) for x in remove_repeats(df).collect()), key=str) == brute(data)


def test_long_text_and_many_copies(spark):
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    data = [(1, long), (2, "start " + long), (3, long[1000:2000])] + [(10 + i, f"{i} common line that every one of these documents holds, word for word {i}") for i in range(300)]
    assert sorted((tuple(x) for x in remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=str) == brute(data)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_refinement_tells_strings_apart():
    r = np.random.default_rng(0)
    text = r.integers(97, 99, 4000).astype(np.uint8)
    for span in (3, 8, 13, 50):
        starts = np.arange(len(text) - span + 1)
        rank = refine(text, starts, span)
        seen = {}
        for s, k in zip(starts, rank):
            assert seen.setdefault(text[s : s + span].tobytes(), k) == k
        assert len(set(seen.values())) == len(seen)


def test_every_start_has_one_anchor():
    raw = bytes(np.random.default_rng(1).integers(0, 3, 3000).astype(np.uint8))
    _, pos, first, last = anchors(raw)
    assert [*first] == [0, *(last[:-1] + 1)] and last[-1] == len(raw) - SPAN
    assert (pos >= last).all() and (pos + 20 <= first + SPAN).all()


def test_hot_grams_go_string_by_string(spark, monkeypatch):
    """Groups of many different surroundings: the same result, with no group gathered."""
    monkeypatch.setattr("webloom.llm.suffix.TASK_SEGMENTS", 1)
    data = rows(5) + [(300 + i, f"{i * 7919} before the passage that all of these hold, and {i * 104729} after it") for i in range(60)]
    got = remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(data)
