"""Line dedup by site-relative frequency.

Pages are grouped by host; for each line, the pages of the host that contain it are divided by all
pages of the host, and lines above a ratio go. Only (host, hash of the line) pairs are shuffled, one
for each page and distinct line and summed before the shuffle, so a host with a third of all pages
is spread over its lines. A host has at most (distinct lines of its average page) / ratio lines
above the ratio, so the list kept for each host is bounded; texts are filtered where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Elements that begin a new line, and the entities that are decoded (the ampersand last).
BLOCKS = "p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|nav|article|section|header|footer|main|aside|title|head|body|html|table|tr|td|th|meta|blockquote|pre|form|figure"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BREAK = rf"(?i)</?(?:{BLOCKS})\b[^>]*>"
EDGES = " \t\r"


def html_text(html: Column) -> Column:
    """The visible text, a line for each block element; scripts, styles and comments go."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, ""), BREAK, "\n"), "<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user or port; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _hashed(text: Column) -> Column:
    """A hash for each line; null for blank ones."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.btrim(x, F.lit(EDGES)) != "", F.xxhash64(F.btrim(x, F.lit(EDGES)))))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """host, line (hash), n_pages, host_pages of the lines that are boilerplate for their host.

    A line counts once a page, without spaces, tabs and carriage returns at its ends; blank lines
    don't count. It is boilerplate if min_pages pages or more have it and they are more than `ratio`
    of the host's pages.
    """
    rows = pages.select(F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("host"), F.col(text_col).cast("string").alias("text"))
    lines = rows.select("host", F.explode(F.array_distinct(_hashed(F.col("text")))).alias("line")).where("line is not null").groupBy("host", "line").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    return lines.join(totals, "host").where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))


#: Up to so many boilerplate lines (a host's name and 8 bytes each) are broadcast as lists by host.
BROADCAST_LINES = 1_000_000


def drop_boilerplate(pages: DataFrame, host_col: str, text_col: str, *, ratio: float = 0.05, min_pages: int = 5, count_cols: tuple[str, str] | None = None, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """`pages` with boilerplate lines cut from text_col; all other columns stay.

    Each row is a page, repeated rows too. A null host is a host of its own, a null text stays null,
    an empty one empty. The other lines stay as they are, joined by newlines. count_cols names two
    columns for the lines before and the lines dropped; columns of these names are replaced.

    Beyond broadcast_lines the pages' hashed lines, not their texts, are joined by (host, line), which
    can be split where a host or line is hot, and each page gets its own list back.
    """
    names = pages.columns
    bad, _ = common.written(boilerplate(pages, host_col, text_col, ratio, min_pages), "boilerplate")
    key, gone, kept = common.unused(pages, "__key", "__gone", "__kept")
    host, text = F.coalesce(F.col(host_col).cast("string"), F.lit("\0")), F.col(text_col).cast("string")
    if bad.count() <= broadcast_lines:
        lists = bad.groupBy(F.col("host").alias(key)).agg(F.collect_list("line").alias(gone))
        joined = pages.join(F.broadcast(lists), host == F.col(key), "left")
    else:
        (page,) = common.unused(pages, "__page")
        pages, _ = common.written(pages.withColumn(page, F.monotonically_increasing_id()), "numbered")
        lines = pages.select(F.col(page).alias("page"), host.alias("host"), F.explode(F.array_distinct(_hashed(text))).alias("line")).where("line is not null")
        lists, _ = common.written(lines.join(bad.select("host", "line").hint("merge"), ["host", "line"]).groupBy(F.col("page").alias(key)).agg(F.collect_list("line").alias(gone)), "lists")
        joined = pages.join(lists, F.col(page) == F.col(key), "left")
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col(gone), F.xxhash64(F.btrim(x, F.lit(EDGES)))))
    joined = joined.withColumn(kept, F.when(F.col(gone).isNull(), F.split(text, "\n")).otherwise(left))
    new = {text_col.lower(): F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n")).alias(text_col)}
    more = {}
    if count_cols:
        before = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("long")
        after = F.when(text.isNull(), F.lit(0)).otherwise(F.size(kept)).cast("long")
        more = {count_cols[0]: before, count_cols[1]: before - after}
    own = [c for c in names if c.lower() not in {m.lower() for m in more}]
    return joined.select(*(new.get(c.lower(), col) for c, col in zip(own, common.columns_of(joined, own))), *(c.alias(n) for n, c in more.items()))


def oracle_lines(source: str, host: str, text: str, ratio: float = 0.05, min_pages: int = 5) -> str:
    """DuckDB: common table expressions that end in `cleaned` (row number r, n_lines, n_dropped, text)."""
    edge = "' ' || chr(9) || chr(13)"
    return f"""src AS (SELECT *, row_number() OVER () AS r, coalesce({host}, chr(1)) AS host_key, {text} AS raw_text FROM {source}),
      all_lines AS (SELECT r, host_key, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS k FROM src),
      totals AS (SELECT host_key, count(*) AS host_pages FROM src GROUP BY 1),
      bad AS (SELECT host_key, line FROM (SELECT DISTINCT r, host_key, trim(line, {edge}) AS line FROM all_lines) JOIN totals USING (host_key)
        WHERE line <> '' GROUP BY 1, 2 HAVING count(*) >= {min_pages} AND count(*) > {ratio} * any_value(host_pages)),
      marked AS (SELECT a.*, b.line IS NOT NULL AS gone FROM all_lines a LEFT JOIN bad b ON a.host_key = b.host_key AND trim(a.line, {edge}) = b.line),
      cleaned AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS new_text FROM marked GROUP BY r)"""


def oracle_html(col: str) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace({col}, '{UNSEEN}', '', 'g'), '{BREAK}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for name, char in ENTITIES:
        out = f"replace({out}, '{name}', '{char if char != chr(39) else chr(39) * 2}')"
    return out
