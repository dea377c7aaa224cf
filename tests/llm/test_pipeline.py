"""Each stage of the pipeline on a small corpus, against what plain Python makes of the stage's own input."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from webloom.llm.text import words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    vocab = {"en": ["the", "of", "thing", "hello", "water", "with"], "de": ["der", "und", "nicht", "wasser", "über", "ein"]}
    word = lambda lang: r.choice(vocab[lang]) + r.choice(["", "a", "bo", "cu", "di"]) + r.choice(["", "x", "y", "z", "w"])
    line = lambda lang, n=14: " ".join(word(lang) for _ in range(n))
    rows = []
    for i in range(150):
        lang = r.choice(["en", "de"])
        rows.append((i, "\n".join(line(lang) for _ in range(4)), lang, f"s{i % 20}", 1))
    shared = "all rights reserved by the makers of this page"
    rows = [(d, t + "\n" + shared if d % 3 == 0 else t, *rest) for d, t, *rest in rows]
    item = line("en", 30)
    rows += [(200 + i, rows[i][1].replace("\n" + shared, "") + " end", rows[i][2], "s1", 1) for i in range(10)]
    half = item.split()
    rows += [(300, f"{line('en')}\n{' '.join(half[15:])} and then {' '.join(half[:15])}\n{line('en')}", "en", "s3", 1), (301, f"{line('en')} {item.upper()} {line('en')}", "en", "s4", 1)]
    rows += [(400, None, "en", "s1", None), (401, "123 --- 456", "en", "s1", 1), (402, "", None, None, 0), (403, shared, "en", "s5", 1)]
    return rows, item


def test_stages(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
    start = {r[0]: r for r in rows}
    assert set(start) - set(kept["language_id"]) == {400, 401, 402}

    sites = defaultdict(set)
    for r in kept["language_id"].values():
        for x in r.text.split("\n"):
            sites[x].add(r.source)
    seen, want = set(), {}
    for d in sorted(kept["language_id"]):
        out = []
        for x in kept["language_id"][d].text.split("\n"):
            if len(sites[x]) < 10 or x not in seen:
                out.append(x)
            seen.add(x)
        want[d] = "\n".join(out)
    assert {d: r.text for d, r in kept["line_dedup"].items()} == {d: t for d, t in want.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for d, r in kept["line_dedup"].items() if r.text != start[d][1])

    before = kept["line_dedup"]
    grams = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, r in before.items() if (w := words(r.text))}
    gone = set()
    for d in sorted(grams):
        if any(o < d and 100 * len(grams[o] & grams[d]) >= 80 * len(grams[o] | grams[d]) for o in grams):
            gone.add(d)
    assert gone >= set(range(200, 210)) and set(before) - set(kept["near_dup"]) == gone

    assert set(kept["near_dup"]) - set(kept["decontaminate"]) == {300, 301}
    packed = kept["packing"]
    assert set(packed) == set(kept["decontaminate"])
    assert all(p.n_tokens == len(kept["decontaminate"][d].text.split()) + 1 <= p.bucket for d, p in packed.items())
    assert len({(p.bucket, p.batch, p.slot) for p in packed.values()}) == len(packed)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
