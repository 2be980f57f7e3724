"""Operator 6: cross-site boilerplate lines by distinct-site spread. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import durable, free_name, maybe_broadcast

#: Distinct sites from which a line counts as boilerplate.
MIN_SITES = 10
#: Estimates within this share of the threshold are settled by an exact count.
MARGIN = 0.3
LG_K = 10


def spread_lines(lines: DataFrame, min_sites: int, margin: float = MARGIN) -> DataFrame:
    """Hashes of the lines of (h, site) that `min_sites` or more distinct sites have.

    Lines of fewer rows than that are out before any sketch is made. The sketches are made by partial
    aggregation before the shuffle and merged after it, so no task holds a line's rows. Estimates
    clear of the threshold decide; the others are counted exactly.
    """
    frequent = durable(lines.groupBy("h").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites).select("h"))
    own = lines.where(F.col("site").isNotNull()).join(maybe_broadcast(frequent, frequent.count()), "h")
    sketched = own.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = durable(sketched.select("h", F.hll_sketch_estimate("sketch").alias("sites")))
    sure = spread.where(F.col("sites") > min_sites * (1 + margin)).select("h")
    near = spread.where(F.col("sites").between(int(min_sites * (1 - margin)), min_sites * (1 + margin))).select("h")
    counted = own.join(maybe_broadcast(near, near.count()), "h", "left_semi").select("h", "site").distinct()
    exact = counted.groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h")
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """All columns of the documents, text without boilerplate lines, n_lines and n_removed.

    Lines end at a newline and are compared without the white space around them; blank lines always
    stay. A null site is no site. A null text has no lines and stays null; an empty text is one blank
    line; repeated rows are treated alike; an empty table gives none. Columns of the documents named n_lines or
    n_removed are replaced, all others stay.
    """
    line = F.regexp_replace(F.col("l"), r"^[ \t\r\x0B\f]+|[ \t\r\x0B\f]+$", "")
    name = lambda c: F.struct(F.xxhash64(c).alias("h"), F.crc32(c).alias("c"), F.octet_length(c).alias("n"))  # noqa: E731  two hashes and the length
    lines = docs.select(name("text").alias("_t"), F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    lines = durable(lines.withColumn("l", line).where("l <> ''").select("_t", "site", "pos", name("l").alias("h")))
    flagged = durable(spread_lines(lines.select("h", "site"), min_sites))
    docs = docs.drop("n_lines", "n_removed")
    t, g, n = free_name(docs, "t"), free_name(docs, "gone"), free_name(docs, "n_gone")
    # What goes from a text depends on the text alone, so copies share a row.
    gone = lines.join(maybe_broadcast(flagged, flagged.count()), "h").groupBy(F.col("_t").alias(t)).agg(F.array_sort(F.collect_set("pos")).alias("at"))
    # A byte a line up to the last one that goes, so that a line is looked up in one step.
    runs = F.zip_with("at", F.concat(F.array(F.lit(-1)), F.slice("at", 1, F.size("at") - 1)), lambda a, b: F.concat(F.repeat(F.lit("0"), a - b - 1), F.lit("1")))
    gone = durable(gone.select(t, F.size("at").alias(n), F.array_join(runs, "").cast("binary").alias(g)))
    # What to remove grows with the documents, so this is a shuffle at every size; hot texts are split by AQE.
    out = docs.withColumn(t, name("text")).join(gone.hint("merge"), t, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda l, i: F.substring(F.col(g), i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    out = out.withColumn("n_lines", n_lines.cast("long")).withColumn("n_removed", F.coalesce(F.col(n), F.lit(0)).cast("long"))
    return out.withColumn("text", F.when(F.col(g).isNull(), F.col("text")).otherwise(kept)).drop(t, g, n)


ORACLE = rf"""
WITH l AS (SELECT rowid AS r, doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
bad AS (SELECT line FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
d AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
        md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '')) AS text_md5
      FROM t LEFT JOIN bad b USING (line) GROUP BY r)
SELECT doc_id, n_lines, n_removed, text_md5 FROM d
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
