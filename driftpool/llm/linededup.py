"""Boilerplate lines by their frequency within a site (operator 4, DataFrame
functions only).

Method: pages are grouped by host; a line's page count within the host, divided
by the host's page total, is its site-relative frequency, and lines above the
ratio are dropped from that host's pages; a line on fewer than ``MIN_PAGES`` pages
is not a repeated one, however small the host. Counting shuffles a 16-byte digest of
each distinct line per page, combined on the map side; page texts are not
shuffled as long as the boilerplate table (at most mean lines per page / ratio
digests for a host) is small enough to broadcast, which is measured, and
otherwise once, in a join whose hot hosts adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpool.llm.common import cut, table

QUERY_NAME = "op4_line_dedup"
#: share of a host's pages that makes a line boilerplate, and the pages that make it
#: a repeated line at all; from 20 pages on the share alone decides
RATIO, MIN_PAGES = 0.1, 3
BROADCAST_BYTES = 32 * 1024 * 1024

#: of a raw page: what holds no text, and what separates lines
SILENT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TAG = r"(?s)<[^>]*>"
BLANKS = r"\n[ \t\r\n]*"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """Host part of a URL in lower case; '' where there is none, null for null."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def page_lines(html: Column) -> Column:
    """Visible text of raw HTML, a line for each stretch between tags."""
    text = F.regexp_replace(F.regexp_replace(html, SILENT, "\n"), TAG, "\n")
    return F.trim(F.regexp_replace(text, BLANKS, "\n"))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(df: DataFrame, host_col: str, text_col: str, ratio: float,
                min_pages: int) -> DataFrame:
    """(host, keys): the digests of each host's boilerplate lines."""
    host = F.col(f"`{host_col}`").alias("host")
    pages = df.select(host, F.col(f"`{text_col}`").alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), F.trim))
    counts = (pages.select("host", F.explode(lines).alias("line")).where("line <> ''")
              .groupBy("host", F.unhex(F.md5("line")).alias("key"))
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    totals = totals.withColumnRenamed("host", "site")
    return (counts.join(totals, F.col("host").eqNullSafe(F.col("site")))
            .where(F.col("n") > F.col("pages") * F.lit(ratio))
            .groupBy("host").agg(F.collect_list("key").alias("keys")))


def drop_boilerplate(df: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text_col``, and columns n_lines
    and n_dropped (a column of either name, in any case, is replaced).

    A line is compared without blanks at its ends; it is boilerplate in a host if
    more than ``ratio`` of the host's pages, and at least ``min_pages``, hold it
    (lines repeated within a page count once; every row is a page, repeated rows
    too). Blank lines are neither counted nor dropped. The other lines keep their
    order and their own white space; rows are never dropped: a page of boilerplate
    alone gets an empty text. Null text stays null with 0 lines; rows with a null
    host are a site of their own. An empty table gives an empty table. Runs the
    counting job."""
    site = cut(boilerplate(df, host_col, text_col, ratio, min_pages)
               .select(F.col("host").alias("__site"), F.col("keys").alias("__keys")), "boilerplate")
    hosts, keys = site.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__keys")), F.lit(0))).first()
    small = hosts * 128 + keys * 32 <= BROADCAST_BYTES
    rows = df.drop("n_lines", "n_dropped").join(
        F.broadcast(site) if small else site.hint("merge"),
        F.col(f"`{host_col}`").eqNullSafe(F.col("__site")), "left")
    text = F.col(f"`{text_col}`")
    lines = F.split(text, "\n")
    digests = F.transform(lines, _key)
    rows = (rows.withColumn("__hits", F.coalesce(F.array_intersect(digests, "__keys"), F.array()))
            .withColumn("__stay", F.when(F.size("__hits") > 0, F.filter(
                lines, lambda x: ~F.array_contains(F.col("__hits"), _key(x))))))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines))
    n_dropped = F.when(F.col("__stay").isNull(), 0).otherwise(F.size(lines) - F.size("__stay"))
    kept = F.when(F.col("__stay").isNull(), text).otherwise(F.array_join("__stay", "\n"))
    own = [kept.alias(c) if c == text_col else F.col(f"`{c}`")
           for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    return rows.select(*own, n_lines.cast("long").alias("n_lines"),
                       n_dropped.cast("long").alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by host: kept text, line count and dropped lines."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", host_of(F.col("url")).alias("host"), page_lines(F.col("html")).alias("text"))
    return drop_boilerplate(pages, "host")


def _oracle() -> str:
    sql = lambda p: p.replace("'", "''")
    return rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '{sql(HOST)}', 1)) AS host,
         trim(regexp_replace(regexp_replace(regexp_replace(html, '{sql(SILENT)}', chr(10), 'g'),
              '{sql(TAG)}', chr(10), 'g'), '{sql(BLANKS)}', chr(10), 'g')) AS text
  FROM pages),
l AS (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
c AS (SELECT host, trim(line) AS line, count(DISTINCT page_id) AS n
      FROM l WHERE trim(line) <> '' GROUP BY ALL),
b AS (SELECT c.host, c.line
      FROM c JOIN (SELECT host, count(*) AS pages FROM p GROUP BY host) t
        ON c.host IS NOT DISTINCT FROM t.host
      WHERE n >= {MIN_PAGES} AND n > pages * CAST({RATIO} AS DOUBLE)),
j AS (SELECT l.page_id, l.line, l.pos, b.line IS NOT NULL AS gone
      FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host AND trim(l.line) = b.line),
s AS (SELECT page_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
             string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text
      FROM j GROUP BY page_id)
SELECT p.page_id, p.host, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped
FROM p LEFT JOIN s ON p.page_id = s.page_id"""


ORACLE_SQL = _oracle()
