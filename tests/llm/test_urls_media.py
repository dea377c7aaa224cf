import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest

from webloom.llm import avi
from webloom.llm.media import clips, padded, text_media
from webloom.llm.urls import Judge, boost, judge_urls, lexical


def plain_rule(host, path):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_verdicts(spark):
    r = random.Random(1)
    urls = [f"http{r.choice(['', 's'])}://{r.choice(['', 'M.', 'blog.'])}{r.choice(['Example', 'other'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es'])}/{r.randint(1, 999)}{r.choice(['', '?a=1&b=2', '#x', '/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "x://HOST?q/en/", "http://com/en/", "http://xcom/en/1", "http://example.com/en", "http://ÄB.com/en/é", "http://a.com/" + "p/" * 5000]
    got = judge_urls(spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")).collect()
    assert len(got) == len(urls)
    for g in got:
        u = urls[g.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        rule, verdict = plain_rule(host, path)
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert g.verdict == verdict if rule else g.verdict in ("allow", "block")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_trees_on_held_out_urls():
    r = random.Random(3)
    make = lambda: (bad := r.random() < 0.5, f"a{r.randint(1, 99)}.{'spam' if bad else 'good'}.org", f"/{'x' * r.randint(1, 9)}/{r.randint(0, 9999) if bad else 'page'}")
    rows = [(f"http://{h}{p}", h, p, b) for b, h, p in (make() for _ in range(600))]
    j = Judge(rows[:400])
    assert ((j([x[:3] for x in rows[400:]]) >= 0.5) == [x[3] for x in rows[400:]]).mean() > 0.97
    assert len(lexical(None, "", "")) == 13
    flat = boost(np.zeros((0, 17)), np.zeros(0))
    assert flat.probability(np.zeros((2, 17))).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 5000])
def test_avi_round_trip(n):
    raw, size = padded("é" * (n // 2) + "x" * (n % 2))
    data = avi.write(raw)
    assert size == n and len(raw) % 64 == 0 and avi.payload(data) == raw
    frames, fps, length = avi.read(data)
    assert length == len(raw) and fps == avi.FPS
    plain = np.stack([avi.decode(f)[0] for f in frames]).reshape(len(frames), avi.BLOCKS, 64)
    assert (plain == avi.coefficients(frames)).all()


def test_avi_of_all_bytes_and_other_tables():
    raw = bytes(range(256)) * 8 + os.urandom(2048) + b"\0\xff" * 64
    raw += b"\0" * (-len(raw) % 64)
    assert avi.payload(avi.write(raw)) == raw
    # Without the index, frames are found in the list itself.
    data = avi.write(raw)
    cut = data[: data.index(b"idx1")]
    cut = cut[:4] + (len(cut) - 8).to_bytes(4, "little") + cut[8:]
    assert avi.read(cut)[0] == avi.read(data)[0]


def test_shots():
    h = np.zeros((12, 16), int)
    h[:5, 2] = h[5:9, 9] = h[9:, 14] = 1024
    assert [(a, z) for a, z, _ in avi.shots(h)] == [(0, 5), (5, 9), (9, 12)]
    assert avi.shots(h[:0]) == []


def test_text_media_and_clips(spark):
    r = random.Random(2)
    rows = [(1, None), (2, ""), (3, "same"), (4, "same"), (5, "ü" * 3000), (None, "x"), (6, "".join(chr(r.randint(32, 5000)) for _ in range(50_000)))]
    got = text_media(spark.createDataFrame([(d, t, b"") for d, t in rows], "doc_id long, text string, media binary")).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    for d, t in rows:
        raw, n = padded(t)
        assert (by[d].n_bytes, by[d].payload_bytes, by[d].payload_sha256, by[d].tail_crc32) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert by[3][1:] == by[4][1:] and by[1][1:] == by[2][1:]
    video = spark.createDataFrame([(1, bytearray(avi.write(b"a" * 4096 + b"\xf0" * 4096))), (2, None), (3, bytearray(b"RIFFxx")), (4, bytearray(b"junk"))], "doc_id long, media binary")
    found = clips(video).collect()
    ones = sorted((x.start_s, x.end_s) for x in found if x.doc_id == 1)
    assert ones[0][0] == 0 and ones[-1][1] == 2.0 and len(ones) >= 2
    assert {x.doc_id for x in found if x.error} == {3, 4} and not [x for x in found if x.doc_id == 2]
    assert text_media(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def jpeg(parts, coefs, width, height, restart=0, tables=False):
    """A baseline JPEG coded plainly, bit by bit: parts (id, across, down), coefs[part] blocks in the order of the scan."""
    codes = {k: {s: f"{c:0{n}b}" for (n, c), s in t.items()} for k, t in avi.STANDARD.items()}
    number = lambda v: "" if not v else f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}"
    at, units = [0] * len(parts), len(coefs[0]) // (parts[0][1] * parts[0][2] if len(parts) > 1 else 1)
    out, bits, last = b"", "", [0] * len(parts)

    def flush():
        nonlocal out, bits
        bits += "1" * (-len(bits) % 8)
        out += int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
        bits = ""

    for u in range(units):
        if restart and u and u % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (u // restart - 1) % 8])
            last = [0] * len(parts)
        for k, (_, across, down) in enumerate(parts):
            for _ in range(across * down if len(parts) > 1 else 1):
                block = coefs[k][at[k]].tolist()
                at[k] += 1
                diff, run = block[0] - last[k], 0
                last[k] = block[0]
                bits += codes[min(k, 1)][abs(diff).bit_length()] + number(diff)
                for v in block[1:]:
                    if v == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + codes[0x10 | min(k, 1)][0xF0], run - 16
                    bits += codes[0x10 | min(k, 1)][run << 4 | abs(v).bit_length()] + number(v)
                    run = 0
                if run:
                    bits += codes[0x10 | min(k, 1)][0]
    flush()
    seg = avi._segment
    head = b"\xff\xd8" + seg(0xE0, b"AVI1") + seg(0xDB, b"\0" + bytes(range(1, 65))) + seg(0xDB, b"\1" + b"\2" * 64)
    head += seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i, a << 4 | d, min(k, 1)]) for k, (i, a, d) in enumerate(parts)))
    if restart:
        head += seg(0xDD, restart.to_bytes(2, "big"))
    scan = bytes([len(parts)]) + b"".join(bytes([i, 0x11 * min(k, 1)]) for k, (i, _, _) in enumerate(parts)) + b"\0\x3f\0"
    return head + seg(0xDA, scan) + out + avi.END


@pytest.mark.parametrize("parts, units, restart", [([(1, 1, 1)], 4, 0), ([(1, 2, 2)], 4, 0), ([(1, 2, 2), (2, 1, 1), (3, 1, 1)], 6, 0), ([(1, 2, 1), (2, 1, 1), (3, 1, 1)], 6, 2), ([(0, 1, 1), (1, 1, 1), (2, 1, 1)], 6, 1)])
def test_colour_frames_with_standard_tables(parts, units, restart):
    r = np.random.default_rng(len(parts) + restart)
    n = [units * (a * d if len(parts) > 1 else 1) for _, a, d in parts]
    coefs = [np.where(r.random((m, 64)) < 0.2, r.integers(-1023, 1024, (m, 64)), 0) for m in n]
    wide, high = (parts[0][1], parts[0][2]) if len(parts) > 1 else (1, 1)
    width, height = 8 * wide * 2 - 3, 8 * high * (units // 2) - 1
    frame = jpeg(parts, coefs, width, height, restart)
    got, quant, w, h = avi.decode(frame)
    assert (w, h) == (width, height) and (got == coefs[0]).all() and quant.tolist() == list(range(1, 65))
    with pytest.raises(ValueError):
        avi.decode(frame[: len(frame) // 2] + avi.END)


def test_clips_of_colour_video_by_opendml_index(spark):
    dark, light = (np.zeros((4, 64), np.int64) for _ in range(2))
    dark[:, 0], light[:, 0] = -900, 900
    parts, grey = [(1, 2, 2), (2, 1, 1), (3, 1, 1)], [np.zeros((1, 64), np.int64)] * 2
    frames = [jpeg(parts, [x, *grey], 16, 16) for x in [dark] * 6 + [light] * 4]
    whole = avi.write(b"")
    header = whole[12 : whole.index(b"movi") - 8]
    body, places = b"movi", []
    for f in frames:
        places.append((len(body) + 8, len(f)))
        body += avi._chunk(b"00dc", f)
    start = 12 + len(header) + 8  # of the word movi
    index = (2).to_bytes(2, "little") + b"\0\1" + len(places).to_bytes(4, "little") + b"00dc" + start.to_bytes(8, "little") + bytes(4) + b"".join(a.to_bytes(4, "little") + (n | 1 << 31).to_bytes(4, "little") for a, n in places)
    movi = avi._chunk(b"LIST", body + avi._chunk(b"ix00", index))
    data = b"RIFF" + (4 + len(header) + len(movi)).to_bytes(4, "little") + b"AVI " + header + movi
    assert avi.read(data)[0] == frames
    more = avi._chunk(b"RIFF", b"AVIX" + avi._chunk(b"LIST", b"movi" + avi._chunk(b"00dc", frames[0])))
    plain = data.replace(b"ix00", b"JUNK")
    assert avi.read(plain + more)[0] == [*frames, frames[0]]
    found = clips(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")).collect()
    assert [(x.start_s, x.end_s, x.frames, x.error) for x in sorted(found, key=lambda x: x.clip)] == [(0.0, 6 / avi.FPS, 6, None), (6 / avi.FPS, 10 / avi.FPS, 4, None)]


def plain_boost(x, y):
    """The same trees by trying every threshold at every node, with the loss's gradients row by row."""
    p = sum(y) / len(y)
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1]).tolist())) for j in range(x.shape[1])]
    base, trees = math.log(p / (1 - p)), []

    def grow(rows, g, h, depth):
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = (1e-6, None)
        if depth < 4:
            for j, own in enumerate(edges):
                gains = []
                for e in own:
                    gl, hl = sum(g[i] for i in rows if x[i, j] <= e), sum(h[i] for i in rows if x[i, j] <= e)
                    gains.append(gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1))
                if gains and max(gains) > best[0] + 1e-12:
                    best = (max(gains), (j, own[int(np.argmax(gains))]))
        if best[1] is None:
            return -0.2 * gs / (hs + 1)
        j, e = best[1]
        return j, e, grow([i for i in rows if x[i, j] <= e], g, h, depth + 1), grow([i for i in rows if x[i, j] > e], g, h, depth + 1)

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    margin = [base] * len(x)
    for _ in range(5):
        q = [1 / (1 + math.exp(-m)) for m in margin]
        trees.append(grow(list(range(len(x))), [a - b for a, b in zip(q, y, strict=True)], [a * (1 - a) for a in q], 0))
        margin = [m + walk(trees[-1], row) for m, row in zip(margin, x, strict=True)]
    return margin


def test_trees_equal_plain_ones(monkeypatch):
    monkeypatch.setattr("webloom.llm.urls.TREES", 5)
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(120, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=120) * 0.3 > 0.2).astype(float)
    assert np.allclose(boost(x, y).margin(x), plain_boost(x, y.tolist()))


def test_a_url_of_many_pages_is_one_row_of_the_fit(spark, monkeypatch):
    seen, init = [], Judge.__init__
    monkeypatch.setattr(Judge, "__init__", lambda self, rows: seen.append(rows) or init(self, rows))
    urls = ["http://a.com/en/1"] * 500 + [f"http://b{i}.org/es/{i}" for i in range(20)] + ["http://x.net/de/1"]
    judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(seen[0]) == 22
