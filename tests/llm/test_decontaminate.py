import random
import time

from pyspark.sql import functions as F

from webloom.llm.decontaminate import Block, contamination, decontamination_stage, tiles
from webloom.llm.text import WordHashes


def brute_tiles(p, t, least):
    """Greedy string tiling as defined: mark the longest match of unmarked ids, first in pattern then text, until too short."""
    mp, mt, out = [False] * len(p), [x == 0 for x in t], []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and not mp[i + n] and not mt[j + n] and p[i + n] == t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        mp[i : i + n], mt[j : j + n] = [True] * n, [True] * n


def test_tiles_are_those_of_brute_force():
    r = random.Random(0)
    for _ in range(4000):
        size = r.choice((1, 2, 2, 3, 4, 6))
        p = [r.randint(1, size) for _ in range(r.randint(1, 24))]
        t = [r.randint(1, size) for _ in range(r.randint(0, 20))]
        for _ in range(r.randint(0, 3)):
            a = r.randrange(len(p))
            t[r.randint(0, len(t)) : 0] = p[a : a + r.randint(3, 12)]
        t = [x if r.random() < 0.97 else 0 for x in t]
        least = r.choice((1, 2, 3, 5))
        assert tiles(p, t, least) == brute_tiles(p, t, least)


def test_occluded_matches_are_found_again():
    assert sum(n for _, _, n in tiles([1, 2, 2, 1, 2, 1, 2, 1, 1, 2, 1, 1, 1], [2, 2, 1, 1, 2, 1, 2, 2, 1, 2], 3)) == 9


def test_repetitive_texts_take_no_pairs():
    began = time.perf_counter()
    block = Block([(1, "same " * 200), (2, "a b " * 300)])
    assert block.best("same " * 100_000, WordHashes(), 0.8) == (1, 1.0)
    assert block.best("b a " * 50_000, WordHashes(), 0.8) == (2, 1.0)
    assert time.perf_counter() - began < 4


def test_reach_is_what_seeds_cover():
    r = random.Random(3)
    for _ in range(200):
        items = [(i, " ".join(r.choice("abc") for _ in range(r.randint(1, 14)))) for i in range(6)]
        text = [r.choice("abc") for _ in range(r.randint(1, 30))]
        block, cache = Block(items), WordHashes()
        got = {(item, reach, tuple(where().tolist()), n) for item, reach, where, n in block.shared(cache.array([w.encode() for w in text]))}
        want = set()
        for i, x in items:
            x = x.split()
            n = min(5, len(x))
            pairs = [(a, b) for a in range(len(x) - n + 1) for b in range(len(text) - n + 1) if x[a : a + n] == text[b : b + n]]
            if pairs:
                want.add((i, len({a + j for a, _ in pairs for j in range(n)}), tuple(sorted({b for _, b in pairs})), n))
        assert got == want


def test_leaks_reordered_passages_edges(spark):
    r = random.Random(5)
    w = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(w) for _ in range(30))) for i in range(20)] + [(50, None), (51, ""), (52, "tiny item"), (None, "x y z")]
    x = items[3][1].split()
    noise = lambda n: " ".join(r.choice(w) for _ in range(n))
    docs = [
        (1, noise(50)), (2, f"{noise(9)} {items[3][1]} {noise(9)}"), (3, f"{' '.join(x[20:])} {noise(5)} {' '.join(x[:12])} so {' '.join(x[12:20])}"), (4, items[4][1].upper().replace(" ", ", ")),
        (5, " ".join(x[:15])), (6, None), (7, ""), (8, "a TINY item here"), (9, "tiny items"), (None, items[5][1]), (10, noise(60_000) + " " + items[6][1]), (2, items[7][1]), (11, f"{items[9][1]} {items[8][1]}"),
    ]
    got = contamination(spark.createDataFrame([(d, t, "q", 1) for d, t in docs], "doc_id long, text string, item_id string, coverage int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((g.doc_id, g.item_id) for g in got), key=str) == sorted([(1, None), (2, 3), (3, 3), (4, 4), (5, None), (6, None), (7, None), (8, 52), (9, None), (None, 5), (10, 6), (2, 7), (11, 8)], key=str)
    assert all((g.coverage is None) == (g.item_id is None) for g in got)


def test_blocks_and_empty(spark, monkeypatch):
    import webloom.llm.decontaminate as m

    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}") for i in range(9)], "doc_id long, text string")
    monkeypatch.setattr(m, "BLOCK_ITEMS", 2)
    assert sorted((g.doc_id, g.item_id) for g in contamination(docs, items).collect()) == [(i, i) for i in range(9)]
    assert contamination(docs.where("false"), items).collect() == []
    assert [g.item_id for g in contamination(docs, items.where("false")).collect()] == [None] * 9
    assert Block([]).best("a b c", WordHashes(), 0.8) is None


def test_whole_query_equals_brute_force(spark, tmp_path):
    """Every document against every item, tiled by the definition; the stage keeps the others, whatever their columns are called."""
    r = random.Random(8)
    w = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(w) for _ in range(r.randint(1, 25)))) for i in range(12)]
    docs = []
    for d in range(120):
        x = [r.choice(w) for _ in range(r.randint(0, 15))]
        for _ in range(r.randint(0, 3)):
            y = r.choice(items)[1].split()
            a = r.randrange(len(y))
            x[r.randint(0, len(x)) : 0] = y[a : a + r.randint(5, 25)]
        docs.append((d, " ".join(x)))
    want = {}
    for d, t in docs:
        held = []
        for i, x in items:
            p = x.split()
            share = sum(n for _, _, n in brute_tiles(p, t.split(), min(5, len(p)))) / len(p)
            if share >= 0.8:
                held.append((-share, i))
        want[d] = min(held)[1] if held else None
    assert 20 < sum(v is None for v in want.values()) < 110
    table = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {g.doc_id: g.item_id for g in contamination(frame, table).collect()} == want
    table.write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = frame.select("*", F.lit(1).alias("_item"), F.lit(2).alias("item_id"), F.lit(3).alias("a.b"), F.lit(4).alias("_share"))
    left = decontamination_stage(spark, wide, str(tmp_path))
    assert left.columns == wide.columns and {x[0] for x in left.collect()} == {d for d, i in want.items() if i is None}
