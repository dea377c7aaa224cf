import math
import random
from collections import Counter

import numpy as np
import pytest
import regex

from webloom.llm.langid import Model, Words, identify, language_stage

VOCAB = {"en": ["the", "house", "with", "water", "morning"], "fr": ["maison", "avec", "leçon", "été", "matin"], "de": ["straße", "wasser", "nicht", "über", "morgen"]}


def rows(n=240):
    r = random.Random(4)
    out = []
    for i in range(n):
        lang = r.choice([*VOCAB])
        out.append((i, " ".join(r.choice(VOCAB[lang]) for _ in range(r.randint(4, 40))), lang))
    return out


def test_held_out_accuracy_edges_and_clashing_columns(spark):
    data = rows() + [(900, None, "en"), (901, "", "en"), (902, "12 34 --", "fr"), (903, "wassermorgen", None), (None, "the house", "en"), (1, "the the", None), (904, "the house " * 40_000, "en")]
    df = spark.createDataFrame([(d, t, x, "zz", 0.0) for d, t, x in data], "doc_id long, text string, lang string, lang_pred string, score double")
    got = identify(df).collect()
    assert len(got) == len(data) and set(df.columns) > {"lang_pred"} and {g.doc_id for g in got} == {d for d, _, _ in data}
    by = {g.doc_id: g for g in got if g.doc_id != 1}
    held = [(d, x) for d, _, x in data if d in by and d is not None and d < 240 and by[d].held_out]
    assert len(held) > 30 and sum(by[d].lang_pred == x for d, x in held) >= 0.98 * len(held)
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (900, 901, 902))
    assert by[903].lang_pred == "de" and by[904].lang_pred == "en" and by[None].lang_pred == "en"
    assert all(0 <= g.score <= 1 for g in got)


def plain(learn, texts):
    """The same by dictionaries of strings, text by text: (language, score)."""
    langs = sorted({x for _, x in learn})
    counts = [Counter() for _ in range(6)]
    for t, x in learn:
        for w in regex.findall(r"\p{L}+", t.lower()):
            counts[0][w, x] += 1
            for n in range(1, 6):
                for i in range(len(w) + 3 - n):
                    counts[n][f" {w} "[i : i + n], x] += 1
    tables = []
    for c in counts:
        keys = {k for k, _ in c if sum(c[k, x] for x in langs) >= 2}
        sums = {x: sum(c[k, x] + 0.5 for k in keys) for x in langs}
        tables.append({k: np.array([math.log((c[k, x] + 0.5) / sums[x]) for x in langs]) for k in keys})
    out = []
    for t in texts:
        words = regex.findall(r"\p{L}+", (t or "").lower())
        total = np.zeros(len(langs))
        for w in words:
            if w in tables[0]:
                total += tables[0][w]
                continue
            for n in range(5, 0, -1):
                if known := [tables[n][g] for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) in tables[n]]:
                    total += np.mean(known, axis=0)
                    break
        p = np.exp((total - total.max()) * min(1, 50 / max(1, len(words))))
        out.append((langs[int(total.argmax())], float(p.max() / p.sum())) if words else ("und", 0.0))
    return out


def test_scores_equal_a_plain_version(spark):
    r = random.Random(9)
    letters = {"a": "abcde\u00e9", "b": "abxyz\u00df", "c": "pqrst\u4e2d"}
    text = lambda x, n: " ".join("".join(r.choice(letters[x]) for _ in range(r.randint(1, 6))) + r.choice(["", ",", "1x", "\u00b2", "_"]) for _ in range(n))
    data = [(i, text(x, r.randint(0, 30)), x) for i in range(150) for x in [r.choice("abc")]] + [(200, text("a", 3) + " " + text("b", 3), None), (201, "\u0660 \u2167 \u2460", None), (202, "\u2167abc\u0301de", "a")]
    got = {g.doc_id: (g.lang_pred, g.score, g.held_out) for g in identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    want = plain([(t, x) for d, t, x in data if not got[d][2] and x], [t for _, t, _ in data])
    for (d, _, _), (lang, score) in zip(data, want, strict=True):
        assert got[d][0] == lang and got[d][1] == pytest.approx(score, abs=1e-4)


def test_backoff_prefers_long_known_grams():
    grams = [(n, h) for n in (1, 2, 5) for h in Words(["hello"]).grams(n)[1].tolist()]
    m = Model(["a", "b"], [n for n, _ in grams], np.array([h for _, h in grams], np.uint64).view(np.int64), [i % 2 for i in range(len(grams))], [5 + i for i in range(len(grams))])
    hello, jello, qqq = m.evidence(["hello", "jello", "qqq"])
    five = m.tables[5][1][m._find(5, Words(["hello"]).grams(5)[1])[0]]
    assert np.allclose(hello, five.mean(axis=0)) and np.allclose(jello, five[m._find(5, Words(["jello"]).grams(5)[1])[1].nonzero()[0]].mean(axis=0))
    assert m._find(1, Words(["qqq"]).grams(1)[1])[1].any() and np.allclose(qqq, m.tables[1][1][m._find(1, Words([""]).grams(1)[1][:1])[0][0]])


def test_stage_keeps_columns_of_any_name(spark):
    data = [(d, t, x, "u", 0.5, 1) for d, t, x in rows(60)] + [(900, None, "en", "u", 0.5, 1), (901, "12", None, "u", 0.5, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, lang_pred string, lang_score double, `a.b` int")
    kept = language_stage(spark, docs, "")
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {d for d, *_ in data if d < 900}
    assert language_stage(spark, docs.where("false"), "").collect() == []


def test_nothing_to_learn_and_empty(spark):
    kind = "doc_id long, text string, lang string"
    assert [(x.lang_pred, x.score) for x in identify(spark.createDataFrame([(1, "the", None)], kind)).collect()] == [("und", 0.0)]
    assert identify(spark.createDataFrame([], kind)).collect() == []
