"""Cross-site boilerplate lines by distinct-site spread: HyperLogLog first, exact counts near the threshold. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import numbered, only, place
from .work import Workspace

MIN_SITES, LG_K, SALTS = 10, 12, 32
#: Six relative standard deviations of a sketch of 2^12 registers.
MARGIN = 6 * 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(flat: DataFrame, min_sites: int, ws: Workspace) -> DataFrame:
    """(line,): keys of lines on ``min_sites`` or more distinct sites, from (line, source) rows.

    Each task sketches the sites of its lines, and the sketches of a line are merged: a line weighs one row a task,
    however often it occurs. Estimates decide, but for those within six deviations of the threshold, whose sites are
    counted exactly. A line that occurs less often than the threshold cannot be on so many sites.
    """
    sketched = flat.where("source is not null").groupBy("line").agg(F.count("*").alias("n"), F.hll_sketch_agg("source", LG_K).alias("sketch"))
    spreads = ws.save(sketched.where(F.col("n") >= min_sites).select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - MARGIN)), "spreads")
    sure = spreads.where(F.col("sites") > min_sites * (1 + MARGIN)).select("line")
    near = spreads.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("line")
    if near.isEmpty():
        return sure
    exact = flat.where("source is not null").join(near, "line", "left_semi").distinct().groupBy("line").count().where(F.col("count") >= min_sites).select("line")
    return sure.unionAll(exact)


def removable_lines(docs: DataFrame, min_sites: int, ws: Workspace) -> DataFrame:
    """(doc_id, text_hash, positions): lines to take out of each text, numbered from 0. Lines go by their MD5 digests."""
    src = only(docs, "doc_id", "text", "source").where("text is not null")
    flat = src.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).where(F.col("line").rlike("[^ ]"))
    flat = flat.select("doc_id", "text_hash", "source", "pos", F.unhex(F.md5("line")).alias("line"))
    found = ws.save(boilerplate_lines(flat.select("line", "source"), min_sites, ws), "boilerplate")
    # A line that a third of the documents has would be one task's: its rows are dealt out by document too.
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = flat.where("doc_id is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS).cast("long")))
    hits = ws.save(own.join(salted(found), ["line", "salt"], "left_semi").select("doc_id", "text_hash", "pos", "line", "salt"), "hits")
    first = hits.groupBy("line").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    later = hits.join(salted(first), ["line", "salt"]).where(F.struct("doc_id", "pos") != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("positions"))


def _cleaned(docs: DataFrame, min_sites: int, ws: Workspace) -> DataFrame:
    """numbered(docs) with n_lines, n_removed and kept, the text without boilerplate."""
    out = removable_lines(docs, min_sites, ws).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), "positions")
    inner, doc, text = numbered(docs), F.col(place(docs, "doc_id")), F.col(place(docs, "text"))
    joined = inner.join(out, (doc == F.col("of")) & (F.xxhash64(text) == F.col("hash")), "left")
    kept = F.array_join(F.filter(_lines(text), lambda _, i: ~F.array_contains("positions", i)), "\n")
    return joined.select(
        *inner.columns,
        F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines"),
        F.when(F.col("positions").isNull(), 0).otherwise(F.size("positions")).cast("long").alias("n_removed"),
        F.when(F.col("positions").isNull(), text).otherwise(kept).alias("kept"),
    )


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, text, source) to (doc_id, n_lines, n_removed, text): the text without cross-site boilerplate.

    A line (between newlines, whole) on ``min_sites`` or more distinct sources is boilerplate; its
    first occurrence, by doc_id and then position, stays, every other goes. Lines of nothing but spaces are
    never removed. Rows with a null source count for no site; rows with a null doc_id count but keep their
    text; a null text stays null with 0 lines; an empty text has one empty line. Rows that repeat a doc_id are
    treated by their own text. An empty table gives an empty one. Further columns are ignored.
    """
    docs = only(docs, "doc_id", "text", "source")
    return _cleaned(docs, min_sites, ws or Workspace(docs.sparkSession)).select(F.col(place(docs, "doc_id")).alias("doc_id"), "n_lines", "n_removed", F.col("kept").alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without their cross-site boilerplate lines: doc_id, n_lines, n_removed, text."""
    return remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = f"""
WITH flat AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL
), boilerplate AS (
  SELECT line FROM flat WHERE regexp_matches(line, '[^ ]') GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), hits AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM flat JOIN boilerplate USING (line)
), marked AS (
  SELECT f.doc_id, f.pos, f.line, coalesce(h.nth > 1, false) AS gone FROM flat f LEFT JOIN hits h USING (doc_id, pos)
)
SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(m.kept, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
) m USING (doc_id)
"""


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; n_chars follows. A document of which nothing is left goes.

    Null and empty texts, and texts without boilerplate, stay as they are; repeated rows are treated each; further
    columns may have any name; an empty table gives an empty one.
    """
    text, chars = place(docs, "text"), place(docs, "n_chars")
    cleaned = _cleaned(docs, MIN_SITES, Workspace(spark)).where("n_removed = 0 or kept rlike '[^ \\n]'")
    new = {text: F.col("kept"), chars: F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(chars)).cast("long")}
    return cleaned.select(*(new.get(f"c{i}", F.col(f"c{i}")) for i in range(len(docs.columns)))).toDF(*docs.columns)
