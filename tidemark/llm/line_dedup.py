"""Boilerplate lines by distinct-site spread.

HyperLogLog sketches of the sites of each line merge by aggregation, one row for each line and task. Lines whose estimate
lies within ``band`` relative standard errors of the threshold are counted exactly, and only their lines and sites are made
distinct. Lines on ``min_sites`` sites or more are boilerplate and are cut from every document.

Lines are compared by a 128-bit hash (two XXH64) of the trimmed line; blank lines are never boilerplate. Texts are split
and hashed once. A line that is everywhere reaches the shuffle as one sketch a task; where lines are joined to what was
found, frequent ones stay in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import joined_evenly, pick, table, written

MIN_SITES, LG_K, BAND = 10, 10, 4.0


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, site, pos, h1, h2 of each line with a visible character; docs has doc, text, site."""
    parts = docs.select("doc", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", r"[\t\r\x0b\f]", " "))
    return parts.withColumn("line", line).where("line != ''").select("doc", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """h1, h2, n, sites, exact of the lines on ``min_sites`` sites or more, which occur n times.

    sites is counted where ``exact``, else estimated. Null sites count as one site.
    """
    key = ["h1", "h2"]
    at = lines.select(*key, F.coalesce("site", F.lit("\0")).alias("site"))
    sketched = at.groupBy(*key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.count("*").alias("n"))
    error = band * 1.04 / (1 << lg_k) ** 0.5 * min_sites + 1
    sketched = written(sketched.where(F.col("sites") >= min_sites - error), "line-spread")
    far = sketched.where(F.col("sites") > min_sites + error).select(*key, "n", "sites", F.lit(False).alias("exact"))
    near = sketched.where(F.col("sites") <= min_sites + error).select(*key, "n")
    sites = joined_evenly(at, near, key, "n").distinct()  # of lines in the band alone
    counted = sites.groupBy(*key).agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).withColumn("exact", F.lit(True))
    return far.unionByName(near.join(counted, key))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """One row for each input row: id, n_lines, n_removed, removed (positions from 0), text without those lines.

    n_lines counts all lines, blank ones too. Null texts stay null with no lines; null sites count as one site; null
    ids and repeated rows stay. Texts may be of any length that a row holds. An empty table gives an empty result.
    """
    base = pick(docs, id=id_col, text=text_col, site=site_col)
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", F.xxhash64("text").alias("h"))
    lines = written(lines_of(base.select(key.alias("doc"), "text", "site")), "line-hashes")  # rows of equal id and text lose the same lines
    common = written(spread(lines, min_sites).select("h1", "h2", "n"), "line-boilerplate")
    hits = joined_evenly(lines.select("doc", "pos", "h1", "h2"), common, ["h1", "h2"], "n")
    gone = hits.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    gone = gone.select(F.col("doc.id").alias("gone_id"), F.col("doc.h").alias("gone_h"), "removed")
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_h"))
    found = base.join(gone, same, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    parts = F.split("text", "\n")
    kept = F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("removed", i), x)), lambda x: x.isNotNull())
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return found.select("id", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"), F.size("removed").alias("n_removed"), "removed", text.alias("text"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_boilerplate(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.octet_length(text).cast("long").alias("kept_bytes"), F.md5(text).alias("kept_md5"),
    )


OP8_SQL = f"""
WITH parts AS (
  SELECT doc_id, source, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos, unnest(string_split(text, chr(10))) AS raw
  FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT *, trim(regexp_replace(raw, '[\\t\\r\\x0b\\f]', ' ', 'g'), ' ') AS line FROM parts
), common AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >= {MIN_SITES}
), marked AS (
  SELECT lines.*, common.line IS NOT NULL AS gone FROM lines LEFT JOIN common ON lines.line = common.line
), cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (WHERE gone), '') AS removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed,
  strlen(coalesce(cleaned.text, ''))::BIGINT AS kept_bytes, md5(coalesce(cleaned.text, '')) AS kept_md5
FROM documents LEFT JOIN cleaned USING (doc_id)
"""
