"""Language ID by word-first backoff: known words by log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import M1, M2, U, fold, mixed, numbered, only, released, slices
from .work import Workspace

WORD, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
#: Of each language, so many labelled documents are expected to be learned from, whatever the table's size; with many
#: languages fewer of each, ALL_DOCS in total. Learned are the LANGUAGES languages with the most documents.
SAMPLE_DOCS, ALL_DOCS, LANGUAGES = 2000, 16_000, 64
LONGEST, SHORTEST = 5, 1
#: Words and n-grams that all sampled documents together have less often are left out of the model.
MIN_COUNT = 2
UND = "und"
#: A naive Bayes posterior is overconfident on long texts, so evidence counts as of so many words at most.
EVIDENCE = 50


def letter_runs(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    found = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return list(chain.from_iterable([w] if w.isalpha() else LETTERS.findall(w) for w in found))


class Words:
    """Distinct words as code points in a row, each between two spaces, with hashes of the words and of their n-grams."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        raw = "".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass")
        self.x = np.frombuffer(raw, np.uint32).astype(np.uint64)
        self.size = np.fromiter(map(len, words), np.int64, self.n) + 2
        self.start = np.cumsum(self.size) - self.size

    def keys(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.x)) - np.repeat(self.start, self.size)
        return mixed(np.add.reduceat(mixed(self.x * M1 + (place + 1).astype(np.uint64) * M2), self.start))

    def grams(self, n: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of each n-gram of the words (those numbered ``which``), one for each place."""
        which = np.arange(self.n) if which is None else which
        count = np.maximum(self.size[which] - n + 1, 0)
        word = np.repeat(which, count)
        at = np.repeat(self.start[which] - np.cumsum(count) + count, count) + np.arange(count.sum())
        h = np.full(len(at), U(n))
        for j in range(n):
            h = mixed(h * M1 + self.x[at + j])
        return word, h


def _numbered_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each word of all texts in a row, words of each text)."""
    vocab: dict[str, int] = {}
    ids = array("q")
    sizes = []
    for t in texts:
        own = letter_runs(t)
        sizes.append(len(own))
        ids.extend([vocab.setdefault(w, len(vocab)) for w in own])
    return list(vocab), np.frombuffer(ids, np.int64), np.array(sizes, np.int64)


def _counted(it):
    """(text, number of the language) to counts of words (n = 0) and n-grams by language."""
    for s in slices(it):
        lang = np.array(s.column(1).to_pylist(), np.int64)
        words, ids, sizes = _numbered_words(s.column(0).to_pylist())
        if not len(ids):
            continue
        w = Words(words)
        pair, c = np.unique(np.repeat(lang, sizes) * w.n + ids, return_counts=True)
        of, word = pair // w.n, pair % w.n
        for x in np.unique(of):
            own, by = word[of == x], np.zeros(w.n, np.int64)
            by[own] = c[of == x]
            for n in range(LONGEST + 1):
                if n:
                    at, keys = w.grams(n, own)
                    keys, where = np.unique(keys, return_inverse=True)
                    total = np.bincount(where, by[at]).astype(np.int64)
                else:
                    keys, total = w.keys()[own], by[own]
                kinds = [np.full(len(keys), x, np.int32), np.full(len(keys), n, np.int32), keys.view(np.int64), total]
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in kinds], names=["lang", "n", "key", "c"])


class Model:
    """Log frequencies per language of words (n = 0) and of n-grams by their hashes, smoothed by half a count."""

    def __init__(self, langs: list[str], ns=(), keys=(), langs_of=(), counts=()):
        self.langs, self.tables = langs, {}
        ns, keys = np.asarray(ns, np.int64), np.asarray(keys, np.int64).view(np.uint64)
        langs_of, counts = np.asarray(langs_of, np.int64), np.asarray(counts, np.float32)
        for n in range(LONGEST + 1):
            own = ns == n
            known, at = np.unique(keys[own], return_inverse=True)
            c = np.full((len(known), len(langs)), 0.5, np.float32)
            np.add.at(c, (at, langs_of[own]), counts[own])
            self.tables[n] = known, np.log(c / c.sum(axis=0, dtype=np.float64)).astype(np.float32)

    def _find(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, whether it is there) of keys."""
        known = self.tables[n][0]
        if not len(known):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return at, known[at] == keys

    def evidence(self, words: list[str]) -> np.ndarray:
        """Per word and language the log frequency; of unseen words the mean over the n-grams of the longest length of
        which any is known, 0 if none is."""
        w = Words(words)
        out = np.zeros((w.n, len(self.langs)))
        at, hit = self._find(0, w.keys())
        out[hit] = self.tables[0][1][at[hit]]
        left = np.flatnonzero(~hit)
        for n in range(LONGEST, SHORTEST - 1, -1):
            if not len(left):
                break
            word, keys = w.grams(n, left)
            at, hit = self._find(n, keys)
            word, rows = word[hit], self.tables[n][1][at[hit]].astype(np.float64)
            if not len(word):
                continue
            cut = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[cut]] = np.add.reduceat(rows, cut, axis=0) / np.diff(np.append(cut, len(word)))[:, None]
            left = np.setdiff1d(left, word[cut], assume_unique=True)
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words, ids, sizes = _numbered_words(texts)
        out = [(UND, 0.0)] * len(texts)
        full = np.flatnonzero(sizes)
        if not len(full) or not self.langs:
            return out
        per = self.evidence(words)
        total = np.add.reduceat(per[ids], (np.cumsum(sizes) - sizes)[full], axis=0)
        p = np.exp((total - total.max(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / sizes[full])[:, None])
        best = total.argmax(axis=1)
        for i, k, x in zip(full.tolist(), best.tolist(), (p[np.arange(len(best)), best] / p.sum(axis=1)).tolist(), strict=True):
            out[i] = self.langs[k], x
        return out


def train(labelled: DataFrame, ws: Workspace, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from (text, lang, doc_id) rows with a language. Whole texts of about ``sample_docs`` documents of
    each language, picked by a hash of the id; words and n-grams seen once are left out. So the model is bounded.
    """
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([])
    most = min(sample_docs, ALL_DOCS // len(langs))
    case = lambda value: F.coalesce(*(F.when(F.col("lang") == x, F.lit(value(i, x))) for i, x in enumerate(langs)))
    part = case(lambda i, x: min(1.0, most / sizes[x]))
    picked = labelled.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)) | F.col("doc_id").isNull() & (part >= 1))
    counts = picked.select("text", case(lambda i, x: i).cast("int").alias("lang")).where("lang is not null").mapInArrow(released(_counted), "lang int, n int, key long, c long")
    per = counts.groupBy("n", "key", "lang").agg(F.sum("c").alias("c"))
    often = per.groupBy("n", "key").agg(F.collect_list(F.struct("lang", "c")).alias("by"), F.sum("c").alias("all")).where(F.col("all") >= MIN_COUNT)
    found = often.select("n", "key", F.explode("by").alias("x")).select("n", "key", "x.lang", "x.c").toArrow()
    return Model(langs, *(c.to_numpy() for c in found.columns))


def predict(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """docs with lang_pred and lang_score of the column called ``text`` added; no column may have these names."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(it):
        for s in slices(it):
            found = held.value.scores(s.column(at).to_pylist())
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*s.columns, *more], names=schema.names)

    return docs.mapInArrow(released(run), schema)


def identify(docs: DataFrame, held_out=None, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, text, lang) to (doc_id, held_out, lang_pred, score): the language of every whole text.

    ``held_out``: a boolean Column of rows not to learn from; by default those with crc32(id) mod 4 = 2. Rows
    with a null lang are never learned from. A text that is null, empty or without a letter is 'und' with
    score 0, and so is every text if nothing can be learned. Among equal languages the first by name wins.
    A null doc_id is not held out. Repeated rows are answered each; an empty table gives an empty one;
    further columns are ignored, whatever their names. score: the posterior among the learned languages.
    """
    src = only(docs, "doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)) if held_out is None else held_out)
    model = train(src.where("not held_out and lang is not null and text is not null").select("doc_id", "text", "lang"), ws or Workspace(docs.sparkSession))
    return predict(src.select("doc_id", "held_out", "text"), model, "text").select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The pipeline keeps a document if its language is known at all and at least this likely.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language; the others stay as they are.

    Learns from all labelled rows of its input, as identify() does; documents with a null or letterless text go.
    Rows are judged one by one, so repeats stay; further columns may have any name; an empty table gives an empty one.
    """
    model = train(only(docs, "doc_id", "text", "lang").where("lang is not null and text is not null"), Workspace(spark))
    out = predict(numbered(docs), model, f"c{docs.columns.index('text')}")
    return out.where((F.col("lang_pred") != UND) & (F.col("lang_score") >= LEAST_SCORE)).drop("lang_pred", "lang_score").toDF(*docs.columns)
