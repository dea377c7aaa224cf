"""LM scoring by online logistic context mixing over the bits of words.

Every token is the bytes of a word and a space. Each bit is predicted from several contexts with the bits of the byte
so far. The first two bytes of a token see the bytes of the token before it in the text: none, its last, its last two.
All later bytes see one, two, three and four bytes before (hashed) and the whole token so far. A context's counts of
zeros and ones over all training tokens give its prediction; these are mixed in the logistic domain with weights that
a gate chooses, trained online, and the mix is refined by an adaptive probability map. A token's probability is the
product over its bits, so a text has so many bits in all.

What is said by a token's own bytes is worked out once for each distinct word: words are sorted, and in a sorted part
the counts of whole prefixes are those of a trie, exact and never hashed, so that they grow with the corpus. Prefixes
that reach over a part's ends are completed from small sums of its neighbours.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import M1, U, fold, mixed, only, released, slices, words
from .work import Workspace

#: log2 of the slots of each hashed context: one to four bytes before; then none, one and two bytes of the word before.
#: Such n-grams are as many as languages have, not as the corpus has words, so these sizes are fixed.
ORDERS, CROSS = (16, 20, 21, 22), (17, 20, 21)
SIZES = tuple(1 << b for b in (*ORDERS, *CROSS))
STARTS = tuple(int(x) for x in np.cumsum([0, *SIZES]))
BLOCK = 1 << 16
#: Bytes of a token that see the token before it.
HEAD = 2
END, SPACE = b"\n", b" "
CONFIDENCE = 12  # buckets of log2 counts
KNOTS, REACH = 33, 8.0
RATE, STEP = 0.02, 2048
#: Distinct words of a sorted part, and nodes of its trie that are held at once.
WORDS_A_PART, NODES = 50_000, 100_000
#: Word beginnings that one task learns from.
STARTS_A_PART = 200_000
HEAD_WORDS = 100_000


# --- counts in a byte each -------------------------------------------------------------------------------------------


def codes(n: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of a byte: exact up to 8, then within 6 %."""
    return np.minimum(np.rint(6 * np.log2(n + 1.0)), 255).astype(np.uint8)


def _decoded() -> np.ndarray:
    n = 2 ** (np.arange(256) / 6) - 1
    return np.where(n < 9, np.rint(n), n)


COUNT = _decoded()


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By kind and pair of codes (n0, n1): the stretched probability of a one and the confidence.

    Kind 0 takes the counts as they are; 1 and 2 take out one zero or one one, the occurrence that is being predicted.
    """
    n0, n1 = COUNT[np.arange(65536) & 255], COUNT[np.arange(65536) >> 8]
    of = [(n0, n1), (np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))]
    return np.concatenate([stretched(a, b) for a, b in of]).astype(np.float32), np.concatenate([confidence(a + b) for a, b in of]).astype(np.uint8)


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The stretched probability of a one, with a prior of 0.4 each way."""
    return np.log((n1 + 0.4) / (n0 + 0.4))


def confidence(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1), CONFIDENCE - 1).astype(np.int64)


STRETCH, CONF = _tables()


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# --- contexts --------------------------------------------------------------------------------------------------------


def _slot(h: np.ndarray, node: np.ndarray, i: int) -> np.ndarray:
    """Slots of table i for contexts with hash h and the bits of the byte so far."""
    return ((((h + node) * M1) >> U(64 - (*ORDERS, *CROSS)[i])) + U(STARTS[i])).astype(np.int64)


def byte_contexts(x: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Hashes of one to four bytes before each byte, 0 past the token's start."""
    out, h = [], np.zeros(len(x), np.uint64)
    wide = x.astype(np.uint64) + U(1)
    for k in range(1, len(ORDERS) + 1):
        before = np.zeros(len(x), np.uint64)
        before[k:] = wide[: max(0, len(x) - k)]
        h = h * U(257) + np.where(place >= k, before, U(0))
        # One byte before and the bits so far fit the table as they are.
        out.append(mixed(h * M1 + U(k)) if k > 1 else h << U(8))
    return out


def body_slots(contexts: list[np.ndarray], at: np.ndarray, node: np.ndarray) -> np.ndarray:
    n = node.astype(np.uint64)
    rows = [(contexts[0][at] + n).astype(np.int64) % SIZES[0] + STARTS[0]]
    return np.stack(rows + [_slot(contexts[i][at], n * U(0x9E3779B97F4A7C15), i) for i in range(1, len(ORDERS))])


def head_slots(quads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots [contexts, 16 bits of each], bits) of word beginnings: two bytes before, two bytes of the token."""
    q = quads.astype(np.uint64)
    t2, t1, b = q >> U(24), (q >> U(16)) & U(255), q & U(0xFFFF)
    shifts = np.arange(16, dtype=np.uint64)
    bits = ((b[:, None] >> (U(15) - shifts)) & U(1)).astype(np.int64).ravel()
    # A node of the 16 bits: a one and the bits so far.
    node = ((U(1) << shifts) | (b[:, None] >> (U(16) - shifts))).ravel()
    first = len(ORDERS)
    per = [np.repeat(mixed(h * M1 + U(i)), 16) for i, h in ((1, t1 + U(1)), (2, (t2 << U(8)) + t1 + U(1)))]
    spread = node * U(0x9E3779B97F4A7C15)
    return np.stack([node.astype(np.int64) + STARTS[first], _slot(per[0], spread, first + 1), _slot(per[1], spread, first + 2)]), bits


# --- mixing ----------------------------------------------------------------------------------------------------------


class Mixer:
    """Weights by gate: confidence of the most specific context, and whether the next one is known better."""

    def __init__(self, n: int):
        # At first the most specific context counts for as much as is known of it, the others for the rest.
        trust = np.repeat(np.minimum(np.arange(CONFIDENCE) / 4, 0.95), 3)
        share = 2.0 ** np.arange(n - 1)
        self.w = np.zeros((CONFIDENCE * 3, n + 1))
        self.w[:, : n - 1] = (1 - trust)[:, None] * share / share.sum()
        self.w[:, n - 1] = trust
        self.steps = 0
        self.apm = np.zeros((CONFIDENCE * 3, KNOTS, 2))
        self.table = None

    @staticmethod
    def gate(conf: np.ndarray, next_: np.ndarray) -> np.ndarray:
        return conf * 3 + np.clip(next_ - conf, 0, 2)

    def mix(self, s: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = self.w[gate]
        out = w[:, -1].copy()
        for j, x in enumerate(s):
            out += w[:, j] * x
        return out

    def learn(self, s: np.ndarray, gate: np.ndarray, bits: np.ndarray, weight: np.ndarray) -> None:
        """One online pass: after each STEP bits the weights move along the gradient of the coding cost."""
        for i in range(0, len(bits), STEP):
            z = slice(i, i + STEP)
            g, b, by = gate[z], bits[z], weight[z]
            x = self.mix(s[:, z], g)
            err = (b - squash(x)) * by
            total = np.bincount(g, by, len(self.w))
            rate = max(RATE, 0.3 / (1 + self.steps) ** 0.5) / np.maximum(total, 1e-9) * np.minimum(total, 1)
            self.steps += 1
            for j, own in enumerate(s[:, z]):
                self.w[:, j] += rate * np.bincount(g, err * own, len(self.w))
            self.w[:, -1] += rate * np.bincount(g, err, len(self.w))
            knot = np.rint((np.clip(x, -REACH, REACH) + REACH) * (KNOTS - 1) / (2 * REACH)).astype(np.int64)
            self.apm += np.bincount((g * KNOTS + knot) * 2 + b, by, self.apm.size).reshape(self.apm.shape)

    def probability(self, s: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a one: the mix, refined by what bits came where the mix was about the same."""
        if self.table is None:
            at = squash(np.linspace(-REACH, REACH, KNOTS))[None, :] * 4
            self.table = ((self.apm[..., 1] + at) / (self.apm.sum(axis=2) + 4)).ravel()
        x = self.mix(s, gate)
        where = (np.clip(x, -REACH, REACH) + REACH) * (KNOTS - 1) / (2 * REACH)
        k = np.minimum(where.astype(np.int64), KNOTS - 2)
        part = where - k
        k += gate * KNOTS
        refined = self.table[k] * (1 - part) + self.table[k + 1] * part
        return np.clip((squash(x) + refined) / 2, 1e-6, 1 - 1e-6)

    def state(self) -> bytes:
        return self.w.tobytes() + self.apm.tobytes()

    def load(self, w: np.ndarray, apm: np.ndarray) -> Mixer:
        self.w, self.apm, self.table = w, apm, None
        return self


def _hashed(pairs: np.ndarray, slots: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(stretched predictions, confidence of the last context) of hashed contexts; own: bits to take out, when learning."""
    at = pairs[slots].astype(np.int64)
    if own is not None:
        at += (own + 1) << 16
    return STRETCH[at], CONF[at[-1]].astype(np.int64)


def head_inputs(pairs: np.ndarray, quads: np.ndarray, learning: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, gate, bits) of word beginnings."""
    slots, bits = head_slots(quads)
    s, conf = _hashed(pairs, slots, bits if learning else None)
    next_ = pairs[slots[-2]].astype(np.int64)
    return s, Mixer.gate(conf, CONF[next_].astype(np.int64)), bits


# --- the trie of a sorted part ---------------------------------------------------------------------------------------

CLZ = np.array([8 - int(i).bit_length() for i in range(256)])


def common_bits(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    diff = np.flatnonzero(x != y)
    if not len(diff):
        return 8 * n
    d = int(diff[0])
    return 8 * d + int(CLZ[x[d] ^ y[d]])


class Part:
    """Sorted distinct keys with counts, as a trie of bits in which each key owns the chain of nodes it adds.

    ``left`` and ``right``: {depth: count} of training tokens in the parts before and after, by the bits they share
    with the first and the last key. A run is a piece of a chain with the same count at all of its nodes.
    """

    def __init__(self, keys: list[bytes], c: np.ndarray, left: dict[int, float] | None = None, right: dict[int, float] | None = None, root: float | None = None):
        self.n = n = len(keys)
        self.x = x = np.frombuffer(b"".join(keys), np.uint8)
        self.len = lens = np.fromiter(map(len, keys), np.int64, n)
        self.start = start = np.cumsum(lens) - lens
        self.c = c = np.asarray(c, np.float64)
        shared = np.zeros(n, np.int64)  # bits in common with the key before
        at = np.arange(1, n)
        for d in range(64):
            if not len(at):
                break
            at = at[(lens[at] > d) & (lens[at - 1] > d)]
            a, b = x[start[at] + d], x[start[at - 1] + d]
            same = a == b
            shared[at[~same]] = 8 * d + CLZ[a[~same] ^ b[~same]]
            at = at[same]
        for i in at.tolist():
            shared[i] = common_bits(keys[i - 1], keys[i])
        self.shared = shared
        # Later parts hang on the last key's path like keys without nodes of their own, the deepest first.
        more = sorted((right or {}).items(), reverse=True)
        depth = shared.tolist() + [d for d, _ in more]
        owner, stack = [-1] * len(depth), []
        for i, d in enumerate(depth):
            while stack and depth[stack[-1]] >= d:
                stack.pop()
            if stack:
                owner[i] = stack[-1]
            if i < n:
                stack.append(i)
        sub = c.tolist() + [float(v) for _, v in more]
        for i in range(len(depth) - 1, -1, -1):
            if owner[i] >= 0:
                sub[owner[i]] += sub[i]
        child = np.flatnonzero(np.array(owner) >= 0)
        own = np.array(owner, np.int64)
        before = sorted((d, v) for d, v in (left or {}).items() if d > 0)
        chain = np.concatenate([own[child], np.arange(n), np.zeros(len(before), np.int64)])
        ends = np.concatenate([np.array(depth, np.int64)[child], 8 * lens, np.array([d for d, _ in before], np.int64)])
        count = np.concatenate([np.array(sub)[child], c, np.array([v for _, v in before], np.float64)])
        order = np.lexsort((ends, chain))
        new = np.append(True, (np.diff(chain[order]) != 0) | (np.diff(ends[order]) != 0))
        run_of = np.empty(len(order), np.int64)
        run_of[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.chain, self.hi = chain[order][at], ends[order][at]
        count = np.add.reduceat(count[order], at)
        first = np.append(True, np.diff(self.chain) != 0)
        down = np.cumsum(count[::-1])[::-1]  # from a run to the end of all
        last = np.append(np.flatnonzero(first)[1:], len(count)) - 1
        after = np.append(down, 0.0)[last + 1]
        self.t = down - after[np.cumsum(first) - 1]
        self.lo = np.where(first, shared[self.chain], np.append(0, self.hi[:-1]))
        # The run above: the one before in the chain, or the one where the chain branches off.
        self.up = np.arange(len(count)) - 1
        branch = np.full(n, -1, np.int64)
        branch[child[child < n]] = run_of[: len(child)][child < n]
        self.up[first] = branch[self.chain[first]]
        total = float(root if root is not None else c.sum())
        self.above = np.where(self.up >= 0, self.t[self.up], total)
        self.last = np.flatnonzero(np.append(first[1:], True))  # of each key

    def ends(self) -> tuple[dict[int, float], dict[int, float]]:
        """{depth: count} of this part's tokens by the bits they share with its first and with its last key."""
        own, out = 8 * self.len, []
        for s in (np.minimum.accumulate(np.append(own[0], self.shared[1:])), np.minimum.accumulate(np.append(own[-1], self.shared[:0:-1]))[::-1]):
            d, at = np.unique(s, return_inverse=True)
            out.append(dict(zip(d.tolist(), np.bincount(at, self.c).tolist(), strict=True)))
        return out[0], out[1]

    def nodes(self, skip: int = 8 * HEAD):
        """Chunks (run, byte position in x, node of the byte, bit, count, count of the sibling) of all nodes below ``skip`` bits."""
        lo = np.maximum(self.lo, skip)
        size = np.maximum(self.hi - lo, 0)
        ends = np.cumsum(size)
        for a in range(0, int(ends[-1]) if len(ends) else 0, NODES):
            z = min(a + NODES, int(ends[-1]))
            r0, r1 = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, z, "left")) + 1
            begin = np.maximum(ends[r0:r1] - size[r0:r1], a)
            run = np.repeat(np.arange(r0, r1), np.minimum(ends[r0:r1], z) - begin)
            step = np.arange(a, z) - (ends - size)[run]  # within the run
            depth = lo[run] + step
            at = self.start[self.chain[run]] + (depth >> 3)
            k = depth & 7
            byte = self.x[at].astype(np.int64)
            t = self.t[run]
            sibling = np.where((step == 0) & (lo[run] == self.lo[run]), self.above[run] - t, 0.0)
            yield run, at, (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1, t, np.maximum(sibling, 0.0)

    def contexts(self) -> list[np.ndarray]:
        return byte_contexts(self.x, np.arange(len(self.x)) - np.repeat(self.start, self.len))

    def inputs(self, pairs: np.ndarray, contexts: list[np.ndarray], at, node, bit, t, sibling, learning: bool = False):
        """(inputs, gate) of nodes; when learning, an occurrence of the bit itself is taken out of every count."""
        s, conf = _hashed(pairs, body_slots(contexts, at, node), bit if learning else None)
        own = np.maximum(t - 1, 0) if learning else t
        one = bit == 1
        whole = stretched(np.where(one, sibling, own), np.where(one, own, sibling))
        return np.vstack([s, whole[None, :]]), Mixer.gate(confidence(own + sibling), conf)

    def scores(self, pairs: np.ndarray, mixer: Mixer) -> np.ndarray:
        """log10 of the probability of each key's bytes after the first HEAD."""
        contexts, cost = self.contexts(), np.zeros(len(self.hi))
        for run, at, node, bit, t, sibling in self.nodes():
            p = mixer.probability(*self.inputs(pairs, contexts, at, node, bit, t, sibling))
            cost += np.bincount(run, np.log10(np.where(bit, p, 1 - p)), len(cost))
        total = cost.tolist()
        for i, up in enumerate(self.up.tolist()):
            if up >= 0:
                total[i] += total[up]
        return np.array(total)[self.last]


def outside(ends: list[tuple[bytes, bytes, dict, dict]]) -> list[tuple[dict, dict]]:
    """Of parts in order, each with its first and last key and Part.ends(): the counts that hang on it from before and after."""

    def cut(sums: dict[int, float], depth: int) -> dict[int, float]:
        out: Counter = Counter()
        for d, v in sums.items():
            if min(d, depth) > 0 and v:
                out[min(d, depth)] += v
        return out

    left, right, n = [], [], len(ends)
    carry: Counter = Counter()
    for p in range(n):
        own = cut(carry, common_bits(ends[p - 1][1], ends[p][0])) if p else Counter()
        left.append(dict(own))
        carry = cut(own, common_bits(ends[p][0], ends[p][1]))
        carry.update(ends[p][3])
    carry = Counter()
    for p in range(n - 1, -1, -1):
        own = cut(carry, common_bits(ends[p][1], ends[p + 1][0])) if p < n - 1 else Counter()
        right.append(dict(own))
        carry = cut(own, common_bits(ends[p][0], ends[p][1]))
        carry.update(ends[p][2])
    return list(zip(left, right[::-1], strict=True))


def _parts(it):
    """(part, keys, counts) of rows (part, key, c, ...) in order, with what further columns there are."""
    part, held = None, []

    def done():
        t = pa.Table.from_batches(held)
        return part, t.column(1).to_pylist(), t.column(2).to_numpy().astype(np.float64), t

    for b in it:
        if not b.num_rows:
            continue
        own = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if part != int(own[a]):
                if held:
                    yield done()
                part, held = int(own[a]), []
            held.append(b.slice(a, z - a))
    if held:
        yield done()


# --- gathering from texts --------------------------------------------------------------------------------------------


def beginnings(texts: list[list[bytes]]) -> np.ndarray:
    """Of each token of texts in a row, the last two bytes before it and its first two, as one number.

    Tokens are words and, last, the end of a text. A text begins as if after an end; 0 stands for a missing byte.
    """
    x = np.frombuffer(b" \n " + b"".join([b" ".join(t) + b" " for t in texts]), np.uint8).astype(np.uint32)
    at = np.flatnonzero(x == 32)[1:-1] + 1
    t2 = np.where(x[at - 3] == 32, 0, x[at - 3])
    return (t2 << 24) | (x[at - 2] << 16) | (x[at] << 8) | x[at + 1]


def _gathered(it):
    """(text, held_out) to partial counts: words (kind 0: c in training texts, a in all), beginnings in training texts (kind 1)."""
    tallies = {False: Counter(), True: Counter()}
    quads: Counter = Counter()

    def rows():
        for held, t in tallies.items():
            own = pa.array(t.values(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(t), np.int32)), pa.array(t.keys(), pa.binary()), pa.array(np.zeros(len(t), np.int64)) if held else own, own], names=["kind", "key", "c", "a"])
            t.clear()
        own = pa.array(quads.values(), pa.int64())
        keys = [int(q).to_bytes(4, "big") for q in quads]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.array(keys, pa.binary()), own, own], names=["kind", "key", "c", "a"])
        quads.clear()

    for s in slices(it):
        learn = []
        for t, held in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
            own = [*words(t), END]
            tallies[held].update(own)
            if not held:
                learn.append(own)
        if learn:
            q, n = np.unique(beginnings(learn), return_counts=True)
            quads.update(dict(zip(q.tolist(), n.tolist(), strict=True)))
        if sum(map(len, tallies.values())) + len(quads) > 100_000:
            yield from rows()
    yield from rows()


PADDED = -(-STARTS[-1] // BLOCK) * BLOCK
COUNTED = "part long, block long, blob binary"


def _counted(it):
    """Sorted parts to the counts of their hashed contexts, and each part's ends (block -1)."""
    flat = np.zeros(STARTS[len(ORDERS)] * 2)
    for part, keys, c, _ in _parts(it):
        p = Part(keys, c)
        contexts = p.contexts()
        for _, at, node, bit, t, _ in p.nodes():
            seen = t > 0
            for row in body_slots(contexts, at[seen], node[seen]):
                np.add.at(flat, row * 2 + bit[seen], t[seen])
        ends = pickle.dumps((keys[0], keys[-1], *p.ends()))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([-1], pa.int64()), pa.array([ends], pa.binary())], names=["part", "block", "blob"])
    yield from _blocks(flat, 0)


def _blocks(flat: np.ndarray, first: int):
    """Counts (zero, one, zero, ...) of the slots from ``first`` on, a row for each block in which there are any."""
    z = zstandard.ZstdCompressor(level=1)
    at = np.flatnonzero(flat)
    n, at = flat[at], at + 2 * first
    block, place = at // (2 * BLOCK), (at % (2 * BLOCK)).astype(np.uint32)
    cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(at))
    for i in range(0, len(cuts) - 1, 16):
        spans = list(zip(cuts[i : i + 16], cuts[i + 1 : i + 17], strict=False))
        blobs = [z.compress(place[a:b].tobytes() + n[a:b].tobytes()) for a, b in spans]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(spans), pa.int64()), pa.array([int(block[a]) for a, _ in spans], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "block", "blob"])


def _counted_heads(it):
    """(key, c) of word beginnings to the counts of their contexts."""
    first = STARTS[len(ORDERS)]
    flat = np.zeros((STARTS[-1] - first) * 2)
    for b in it:
        for s in slices([b], 10_000):
            q = np.frombuffer(b"".join(s.column(0).to_pylist()), ">u4")
            slots, bits = head_slots(q)
            by = np.repeat(s.column(1).to_numpy().astype(np.float64), 16)
            for row in slots:
                np.add.at(flat, (row - first) * 2 + bits, by)
    yield from _blocks(flat, first)


def _added(it):
    """Rows (block, blob) to the codes of each block's sums."""
    total: dict[int, np.ndarray] = {}
    z = zstandard.ZstdDecompressor()
    for b in it:
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = z.decompress(t)
            third = len(raw) // 3
            if k not in total:
                total[k] = np.zeros(2 * BLOCK)
            total[k][np.frombuffer(raw[:third], np.uint32)] += np.frombuffer(raw[third:])
    blobs = [zlib.compress(codes(t).tobytes(), 1) for t in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(blobs, pa.binary())], names=["block", "blob"])


# --- learning --------------------------------------------------------------------------------------------------------

STATE = "seen double, state binary"


def _averaged(size: int):
    """Mixers, weighted by what they have seen, and the sums of their maps."""

    def run(it):
        total, seen = None, 0.0
        for b in it:
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(t).copy()
                part[:size] *= n
                total, seen = part if total is None else total + part, seen + n
        if seen:
            total[:size] /= seen
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=["seen", "state"])

    return run


def _state(mixer: Mixer, seen: float):
    return pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([mixer.state()], pa.binary())], names=["seen", "state"])


def _merged(states: DataFrame, n: int, ws: Workspace) -> Mixer:
    blank = Mixer(n)
    size = blank.w.size
    found = ws.collect(states.repartition(4).mapInArrow(_averaged(size), STATE))
    if found:
        seen = sum(r.seen for r in found)
        arrays = [np.frombuffer(bytes(r.state)) for r in found]
        w = sum(a[:size] * (r.seen / seen) for a, r in zip(arrays, found, strict=True))
        blank.load(w.reshape(blank.w.shape), sum(a[size:] for a in arrays).reshape(blank.apm.shape))
    return blank


class Model:
    """Codes of counts by slot and the trained mixers."""

    def __init__(self, pairs: np.ndarray, body: Mixer, head: Mixer):
        self.pairs, self.body, self.head = pairs, body, head

    def beginnings(self, quads: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's first two bytes after the token before."""
        s, gate, bits = head_inputs(self.pairs, quads)
        p = self.head.probability(s, gate)
        return np.log10(np.where(bits, p, 1 - p)).reshape(-1, 16).sum(axis=1)


def train(units: DataFrame, words_: int, n: int, ws: Workspace) -> tuple[Model, DataFrame]:
    """From (kind, key, c, a) over all texts, so many distinct words and n training tokens, to the model and (key, c, a, body).

    body: log10 of the probability of a word's bytes after the first two. Each part of the sorted words and of the
    beginnings trains a mixer online, every bit weighing as often as it occurs, on predictions from which one
    occurrence of the bit is taken out; the parts' weights are averaged by what they have seen. What passes the
    driver is a fixed number of codes of counts, and of each part its two ends.
    """
    spark = units.sparkSession
    parts = max(1, -(-words_ // WORDS_A_PART))
    keyed = units.where("kind = 0").select(F.concat("key", F.lit(SPACE)).alias("key"), "c", "a")
    table = ws.save(keyed.repartitionByRange(parts, "key").select(F.spark_partition_id().cast("long").alias("part"), "key", "c", "a"), "words")
    ordered = lambda *cols: table.select("part", "key", *cols).repartition(parts, "part").sortWithinPartitions("part", "key")
    starts = units.where("kind = 1").select("key", "c")
    quads = starts.count()
    dealt = starts.repartition(max(1, -(-quads // STARTS_A_PART)), F.xxhash64("key")).sortWithinPartitions(F.xxhash64("key"))

    counts = ws.save(ordered("c").mapInArrow(released(_counted), COUNTED).unionAll(dealt.mapInArrow(released(_counted_heads), COUNTED)), "counts")
    ends = [pickle.loads(bytes(r.blob)) + (r.part,) for r in ws.collect(counts.where("block < 0").select("part", "blob"))]
    ends.sort(key=lambda e: e[-1])
    around = {e[-1]: x for e, x in zip(ends, outside([e[:4] for e in ends]), strict=True)}
    pairs = np.zeros(PADDED, np.uint16)
    sums = counts.where("block >= 0").select("block", "blob")
    for r in ws.collect(sums.repartition(16, "block").mapInArrow(_added, "block long, blob binary")):
        pairs[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(zlib.decompress(bytes(r.blob)), "<u2")
    ws.drop(counts)
    held = spark.sparkContext.broadcast((pairs, around))

    def learned(it):
        pairs, around = held.value
        for part, keys, c, _ in _parts(it):
            if not c.any():
                continue
            p, mixer, seen = Part(keys, c, *around[part], n), Mixer(len(ORDERS) + 1), 0.0
            contexts = p.contexts()
            for _, at, node, bit, t, sibling in p.nodes():
                some = t > 0
                at, node, bit, t, sibling = (v[some] for v in (at, node, bit, t, sibling))
                if not len(t):
                    continue
                # Neighbours in the trie are alike, so a pass goes over them in a mixed order.
                order = np.argsort(mixed(at.astype(np.uint64) * U(8) + node.astype(np.uint64)), kind="stable")
                at, node, bit, t, sibling = (v[order] for v in (at, node, bit, t, sibling))
                mixer.learn(*p.inputs(pairs, contexts, at, node, bit, t, sibling, learning=True), bit, t / t.mean())
                seen += float(t.sum())
            if seen:
                yield _state(mixer, seen)

    def learned_heads(it):
        pairs, _ = held.value
        mixer, seen = Mixer(len(CROSS)), 0.0
        for b in it:
            for s in slices([b], 10_000):
                by = np.repeat(s.column(1).to_numpy().astype(np.float64), 16)
                mixer.learn(*head_inputs(pairs, np.frombuffer(b"".join(s.column(0).to_pylist()), ">u4"), learning=True), by / by.mean())
                seen += float(by.sum())
        if seen:
            yield _state(mixer, seen)

    body = _merged(ordered("c").mapInArrow(released(learned), STATE), len(ORDERS) + 1, ws)
    head = _merged(dealt.mapInArrow(released(learned_heads), STATE), len(CROSS), ws)
    weights = (body.w, body.apm)

    def scored(it):
        pairs, around = held.value
        mixer = Mixer(len(ORDERS) + 1).load(*weights)
        for part, keys, c, t in _parts(it):
            own = Part(keys, c, *around[part], n).scores(pairs, mixer)
            yield pa.RecordBatch.from_arrays([pa.array([k[:-1] for k in keys], pa.binary()), *(t.column(i).combine_chunks() for i in (2, 3)), pa.array(own)], names=["key", "c", "a", "body"])

    vocabulary = ws.save(ordered("c", "a").mapInArrow(released(scored), "key binary, c long, a long, body double"), "vocabulary")
    held.destroy()
    ws.drop(table)
    return Model(pairs, body, head), vocabulary


# --- scoring ---------------------------------------------------------------------------------------------------------


def _frequent(vocabulary: DataFrame, room: int, ws: Workspace) -> int | None:
    """The least number of occurrences from which on words are at most ``room``; sizes by power of 2 ** 0.25 are bounded."""
    least = None
    for r in sorted(ws.collect(vocabulary.groupBy(F.floor(4 * F.log2("a")).alias("s")).agg(F.count("*").alias("n"), F.min("a").alias("low"))), key=lambda r: -r.s):
        if (room := room - r.n) < 0:
            break
        least = r.low
    return least


def score(docs: DataFrame, learn, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    ``learn``: a boolean Column of rows to learn from. base_score: log10 probability with add-half smoothed
    counts of whole words; score: that of the mixed bits of all words, in their order, and the end; bits_per_byte:
    -score in bits over the text's bytes (at least one). What words say is looked up in a broadcast for the most
    frequent ones (at most HEAD_WORDS) and joined for all others, one row for each document and word, with the same
    result. A null text is empty: one token, the end. Rows are scored one by one, so repeats and null ids stay; null
    ids are neither held out nor left out of learning. Without training rows every count is 0 and the mixer is
    untrained. An empty table gives an empty one; further columns are ignored.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark)
    src = only(docs, "doc_id", "text").select("doc_id", "text", (~learn).alias("held_out"))
    partial = src.select("text", "held_out").mapInArrow(released(_gathered), "kind int, key binary, c long, a long")
    units = ws.save(partial.groupBy("kind", "key").agg(F.sum("c").alias("c"), F.sum("a").alias("a")), "units")
    all_, v, n = units.where("kind = 0").agg(F.count("*"), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    model, vocabulary = train(units, all_, n, ws)
    least = _frequent(vocabulary, HEAD_WORDS, ws)
    unit = 0.5 * (v + 1)
    top = ws.collect(vocabulary.where(F.col("a") >= least)) if least is not None else []
    c = np.array([r.c for r in top], np.float64)
    facts = np.stack([np.log10((c + 0.5) / (n + unit)), (c > 0).astype(np.float64), np.array([r.body for r in top], np.float64), np.zeros(len(top))])
    facts = np.concatenate([facts, np.array([[0.0], [0.0], [0.0], [1.0]])], axis=1)  # the last: not a frequent word
    held = spark.sparkContext.broadcast((model.pairs, (model.head.w, model.head.apm), {bytes(r.key): i for i, r in enumerate(top)}, facts))

    def scored(it):
        pairs, state, known, facts = held.value
        model = Model(pairs, None, Mixer(len(CROSS)).load(*state))
        have, of = np.zeros(0, np.uint32), np.zeros(0)
        none = facts.shape[1] - 1
        for s in slices(it):
            texts = s.column(1).to_pylist()
            tokens = [[*words(t), END] for t in texts]
            lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
            doc = np.repeat(np.arange(len(tokens)), lens)
            at = np.fromiter((known.get(w, none) for t in tokens for w in t), np.int64, len(doc))
            base, seen, body = (np.bincount(doc, row[at], len(tokens)) for row in facts[:3])
            q, where = np.unique(beginnings(tokens), return_inverse=True)
            new = q[~np.isin(q, have, assume_unique=True)]
            if len(new):
                if len(have) > 500_000:
                    have, of, new = np.zeros(0, np.uint32), np.zeros(0), q
                own = np.concatenate([model.beginnings(new[i : i + 10_000]) for i in range(0, len(new), 10_000)])
                have, of = np.concatenate([have, new]), np.concatenate([of, own])
                order = np.argsort(have)
                have, of = have[order], of[order]
            head = np.bincount(doc, of[np.searchsorted(have, q)][where], len(tokens))
            rare = np.flatnonzero(at == none)
            offsets = np.cumsum(lens) - lens
            tally = Counter((d, tokens[d][i]) for d, i in zip(doc[rare].tolist(), (rare - offsets[doc[rare]]).tolist(), strict=True))
            ends = np.append(0, np.cumsum(np.bincount(np.fromiter((d for d, _ in tally), np.int64, len(tally)), minlength=len(tokens))))
            tail = pa.StructArray.from_arrays([pa.array([w for _, w in tally], pa.binary()), pa.array(tally.values(), pa.int64())], ["word", "k"])
            size = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [s.column(0), s.column(2), pa.array(lens), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(body + head), pa.array(size), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)],
                names=["doc_id", "held_out", "n_tokens", "seen", "base", "score", "size", "tail"],
            )

    kinds = "doc_id long, held_out boolean, n_tokens long, seen long, base double, score double, size long, tail array<struct<word: binary, k: long>>"
    rows = ws.save(src.mapInArrow(released(scored), kinds).withColumn("row", F.monotonically_increasing_id()), "scored")
    held.destroy()
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("key"), F.col("t.k").alias("k"))
    counted = tail.join(vocabulary.where(F.col("a") < least) if least is not None else vocabulary, "key")
    more = counted.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_seen"),
        F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / F.lit(n + unit))).alias("more_base"),
        F.sum(F.col("k") * F.col("body")).alias("more_body"),
    )
    whole = F.col("score") + F.coalesce("more_body", F.lit(0.0))
    return rows.drop("tail").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more_seen", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), whole.alias("score"), (-whole * 3.321928094887362 / F.greatest("size", F.lit(1))).alias("bits_per_byte"),
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, learned from all rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.coalesce(fold(F.col("doc_id"), 5) != 1, F.lit(True)))
