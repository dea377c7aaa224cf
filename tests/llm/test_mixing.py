import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import mixing
from webloom.llm.mixing import CROSS, END, ORDERS, Mixer, Model, Part, beginnings, outside, score
from webloom.llm.text import fold, words


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 1


def bits_of(key):
    return "".join(f"{b:08b}" for b in key)


def some_keys(r, n):
    out = {bytes(r.choice(b"ab\x01\xc3z") for _ in range(r.choice((1, 1, 2, 3, 5)))) + b" " for _ in range(n)}
    if n > 10:
        out |= {b"q" * 200 + b" ", b"q" * 199 + b"r ", b"q" * 80 + b" "}
    return sorted(out)


def test_trie_counts_equal_those_of_all_prefixes():
    """Counts and siblings of every node, whole and cut into parts that only know each other's ends."""
    r = random.Random(1)
    for _ in range(300):
        keys = some_keys(r, r.choice((1, 2, 5, 40)))
        c = [r.choice((0, 0, 1, 2, 50)) for _ in keys]
        under = Counter()
        for k, x in zip(keys, c, strict=True):
            b = bits_of(k)
            for d in range(len(b) + 1):
                under[b[:d]] += x
        cuts = sorted({0, len(keys), *(r.randint(0, len(keys)) for _ in range(r.choice((0, 1, 4))))})
        pieces = [(keys[a:z], np.array(c[a:z])) for a, z in zip(cuts, cuts[1:], strict=False)]
        around = outside([(k[0], k[-1], *Part(k, x).ends()) for k, x in pieces])
        for (own, x), (left, right) in zip(pieces, around, strict=True):
            p = Part(own, x, left, right, sum(c))
            seen = Counter()
            for run, at, node, bit, t, sibling in p.nodes(0):
                for i, a, m, b, u, v in zip(p.chain[run], at, node, bit, t, sibling, strict=True):
                    prefix = bits_of(own[i])[: 8 * (a - p.start[i]) + int(m).bit_length() - 1]
                    assert bin(m)[3:] == bits_of(own[i])[8 * (a - p.start[i]) : len(prefix)]
                    assert (u, v) == (under[prefix + str(b)], under[prefix + str(1 - b)])
                    seen[prefix + str(b)] += 1
            assert set(seen.values()) == {1} and len(seen) == len({bits_of(k)[:d] for k in own for d in range(1, 8 * len(k) + 1)})


def random_model(r):
    pairs = r.integers(0, 65536, mixing.PADDED).astype(np.uint16)
    body, head = Mixer(len(ORDERS) + 1), Mixer(len(CROSS))
    for m in (body, head):
        m.apm[:] = r.random(m.apm.shape)
    return Model(pairs, body, head)


def plain(model, tail, word, training):
    """log10 of a token's probability bit by bit: dictionaries for the whole prefix, the model's tables for the rest."""
    total = sum(training.values())
    key = word + b" "
    q = int.from_bytes(tail + key[:2], "big")
    out = float(model.beginnings(np.array([q], np.uint32))[0])
    for d in range(2, len(key)):
        for k in range(8):
            at = 8 * d + k
            prefix, bit = bits_of(key)[:at], int(bits_of(key)[at])
            n = [sum(c for w, c in training.items() if bits_of(w + b" ").startswith(prefix + str(b))) for b in (0, 1)]
            node = (1 << k) | (key[d] >> (8 - k))
            contexts = mixing.byte_contexts(np.frombuffer(key, np.uint8), np.arange(len(key)))
            pair = model.pairs[mixing.body_slots(contexts, np.array([d]), np.array([node]))[:, 0]]
            n0, n1 = mixing.COUNT[pair & 255], mixing.COUNT[pair >> 8]
            s = [*np.log((n1 + 0.4) / (n0 + 0.4)), math.log((n[1] + 0.4) / (n[0] + 0.4))]
            conf = lambda n: int(min(math.log2(n + 1), 11))
            gate = conf(sum(n)) * 3 + min(max(conf(n0[-1] + n1[-1]) - conf(sum(n)), 0), 2)
            x = model.body.w[gate, -1] + sum(a * b for a, b in zip(model.body.w[gate], s, strict=False))
            knots = np.linspace(-8, 8, 33)
            table = (model.body.apm[gate, :, 1] + 4 / (1 + np.exp(-knots))) / (model.body.apm[gate].sum(axis=1) + 4)
            p = min(max((1 / (1 + math.exp(-x)) + np.interp(x, knots, table)) / 2, 1e-6), 1 - 1e-6)
            out += math.log10(p if bit else 1 - p)
    assert total
    return out


def test_scores_equal_a_plain_mixer():
    r = np.random.default_rng(3)
    model = random_model(r)
    training = {b"anna": 3, b"anno": 1, b"ant": 7, b"b": 2, b"bo": 1, b"bonbon": 4, END: 5}
    ask = sorted({*training, b"annul", b"bonb", b"x", b"xyzzy"}, key=lambda w: w + b" ")
    p = Part([w + b" " for w in ask], np.array([training.get(w, 0) for w in ask]))
    got = p.scores(model.pairs, model.body)
    for w, x in zip(ask, got, strict=True):
        q = np.array([int.from_bytes(b"\0\n" + (w + b" ")[:2], "big")], np.uint32)
        assert x + model.beginnings(q)[0] == pytest.approx(plain(model, b"\0\n", w, training), rel=1e-5)


def test_probabilities_sum_to_one():
    """The first two bytes of a token, over all that they can be."""
    model = random_model(np.random.default_rng(0))
    q = np.array([(97 << 24) | (98 << 16) | i for i in range(65536)], np.uint32)
    assert (10 ** model.beginnings(q)).sum() == pytest.approx(1)


def test_beginnings_reach_over_the_start():
    got = [int(q).to_bytes(4, "big") for q in beginnings([[b"ab", b"c", b"def", END], [END], [b"x", END]])]
    assert got == [b"\0\nab", b"abc ", b"\0cde", b"ef\n ", b"\0\n\n ", b"\0\nx ", b"\0x\n "]


def test_counts_base_and_gain(spark):
    r = random.Random(2)
    syl = ["an", "the", "ou", "re", "st", "in", "o"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 80)))) for i in range(400)] + [(900, None), (901, ""), (902, "Ünseen\x00 \n x"), (903, "The tHE"), (None, "the an"), (5, "the an"), (5, "the an"), (904, "y" * 100_000), (905, "the " * 50_000)]
    got = [x for x in score(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, c int"), F.coalesce(fold(F.col("doc_id"), 5) != 1, F.lit(True))).collect()]
    c = Counter()
    for d, t in rows:
        if d is None or not held(d):
            c.update(words(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in rows:
        ws = [*words(t), None]
        want[d, bool(d is not None and held(d)), len(ws), sum(w in c for w in ws), n, f"{sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws):.6g}"] += 1
    assert want == Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, f"{x.base_score:.6g}") for x in got)
    out = [x for x in got if x.held_out]
    assert sum(x.score for x in out) > 1.02 * sum(x.base_score for x in out)
    size = {d: len((t or "").encode()) for d, t in rows}
    assert all(x.bits_per_byte == pytest.approx(-x.score * math.log2(10) / max(1, size[x.doc_id])) for x in got if x.doc_id not in (None, 5))


def test_empty_and_no_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score(none, F.lit(True)).collect() == []
    x = score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert x.n_known == 0 and x.train_tokens == 0 and x.held_out and x.score < 0


def test_broadcast_and_parts_change_nothing(spark, monkeypatch):
    """HEAD_WORDS bounds a broadcast; parts only cut the sorted words: with learning left out, scores are the same."""
    rows = [(i, f"word{i % 40} only{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {x.doc_id: x.score for x in score(docs, F.lit(True)).collect()}
    monkeypatch.setattr("webloom.llm.mixing.HEAD_WORDS", 1)
    assert {x.doc_id: x.score for x in score(docs, F.lit(True)).collect()} == pytest.approx(whole)
    monkeypatch.setattr("webloom.llm.mixing._merged", lambda states, n, ws: Mixer(n))
    one = {x.doc_id: x.score for x in score(docs, F.lit(True)).collect()}
    monkeypatch.setattr("webloom.llm.mixing.WORDS_A_PART", 7)
    assert {x.doc_id: x.score for x in score(docs, F.lit(True)).collect()} == pytest.approx(one)


def test_order_of_words_counts(spark):
    """Words in their usual order score better than the same words in another one."""
    r = random.Random(5)
    then = {f"w{i}x{chr(97 + i)}q": f"{chr(122 - i)}y{i}" for i in range(20)}
    prose = lambda n: [x for w in r.choices(list(then), k=n) for x in (w, then[w])]
    rows = [(i, " ".join(prose(30))) for i in range(200)]
    own = prose(40)
    rows += [(1000, " ".join(own)), (1001, " ".join(r.sample(own, len(own))))]
    got = {x.doc_id: x.score for x in score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000).collect()}
    assert got[1000] > 0.8 * got[1001]
