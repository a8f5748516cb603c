"""URL filters: a temporal join of captures with dated list entries.

Entries are events (list, kind, value, at, active): from time ``at`` on, the list holds the value or
no longer does. Events of one value become validity intervals: an event holds until the next one.
A capture is blocked by a list if one of its keys is active there at fetch time. Its keys are the
URL without scheme, query, fragment and closing slash (kind ``url``), its host (``host``) and
every suffix of the host from two labels on (``domain``, which so covers subdomains).

The join is an as-of join without a range condition: events and keyed captures are put in one order
of time, and each capture takes the latest event before it. A host may hold a third of all captures
and entries, so the order is kept per (value, ``SPAN`` of time): the state at the start of each span
comes from a table of one row per value, list and span. Values no capture has, and captures'
keys no list has, drop out first. No task needs all rows of a value.

An event holds from its own time on; of events of one value at the same time the active one holds.
Null URLs and fetch times, and URLs without a host, match nothing: not blocked. Events with a null
in any column are passed over. Repeated captures are judged each on its own; repeated events count
once. Without entries nothing is blocked. Other columns are not read. Only DataFrame functions are
used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relloom.session import materialise

#: Length of a span in the unit of the times given.
SPAN = 30


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and closing dot; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def location(url: Column) -> Column:
    """Host and path of a URL without query, fragment and closing slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host(url), F.regexp_replace(path, "/+$", ""))


def intervals(events: DataFrame) -> DataFrame:
    """Written validity intervals (list, kind, value, at, until, active); ``until`` null: open.

    For inspection and for callers with their own join; the filter itself needs the events only.
    """
    clean = _events(events)
    following = W.partitionBy("list", "kind", "value").orderBy("at")
    return materialise(clean.withColumn("until", F.lead("at").over(following)))


def _events(events: DataFrame) -> DataFrame:
    rows = events.select("list", "kind", "value", F.col("at").cast("long").alias("at"), "active").dropna()
    return rows.groupBy("list", "kind", "value", "at").agg(F.max("active").alias("active"))


def _keys(captures: DataFrame, url_col: str) -> DataFrame:
    """(kind, value) rows of each distinct (url, at)."""
    h = F.col("_host")
    labels = F.split(h, r"\.")
    suffixes = F.when(
        F.size(labels) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.size(labels) - 1),
            lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")),
        ),
    ).otherwise(F.expr("cast(array() as array<struct<kind:string,value:string>>)"))
    own = F.array(
        F.struct(F.lit("url").alias("kind"), location(F.col("_url")).alias("value")),
        F.struct(F.lit("host").alias("kind"), h.alias("value")),
    )
    named = captures.select(F.col(url_col).alias("_url"), "at", host(F.col(url_col)).alias("_host")).where("_host IS NOT NULL")
    return named.select(
        F.col("_url").alias("url"), "at", F.explode(F.concat(own, suffixes)).alias("k")
    ).select("url", "at", "k.kind", "k.value")


def blocked(
    captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "at",
    span: int = SPAN,
) -> DataFrame:
    """(page_id, host, at, n_active, lists, blocked) for every capture.

    ``n_active``: active entries that match; ``lists``: their lists, sorted and comma-joined.
    """
    rows = materialise(
        captures.select(
            F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("long").alias("at")
        )
    )
    clean = materialise(_events(events).withColumn("span", F.floor(F.col("at") / span)))
    keyed = _keys(rows.where("url IS NOT NULL AND at IS NOT NULL").select("url", "at").distinct(), "url")
    listed = clean.select("kind", "value", "list").distinct()
    asked = keyed.join(listed, ["kind", "value"]).withColumn("span", F.floor(F.col("at") / span))

    # The state at the start of each span that has events: the latest event of any earlier span.
    value = ["list", "kind", "value"]
    closing = clean.groupBy(*value, "span").agg(F.max_by("active", "at").alias("closing"))
    later = W.partitionBy(*value).orderBy("span")
    states = materialise(closing.withColumn("next_span", F.lead("span").over(later)))

    # Inside a span: events and captures in order of time, an event before captures of its time.
    mixed = clean.select(*value, "span", "at", F.lit(0).alias("turn"), "active", F.lit(None).cast("string").alias("url")).unionByName(
        asked.select(*value, "span", "at", F.lit(1).alias("turn"), F.lit(None).cast("boolean").alias("active"), "url")
    )
    order = W.partitionBy(*value, "span").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    latest = mixed.withColumn("state", F.last("active", ignorenulls=True).over(order)).where("turn = 1")
    inside = latest.where("state IS NOT NULL").select("list", "url", "at", "state")
    before = latest.where("state IS NULL").select(*value, "span", "url", "at")
    # The last span with events before the capture's own: spans of one value do not overlap.
    carried = before.join(
        states.withColumnRenamed("span", "from_span"), value
    ).where("from_span < span AND (next_span IS NULL OR next_span >= span)").select(
        "list", "url", "at", F.col("closing").alias("state")
    )
    active = inside.unionByName(carried).where("state")
    per_capture = active.groupBy("url", "at").agg(
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")
    ).select(F.col("url").alias("_url"), F.col("at").alias("_at"), "n_active", "lists")
    return rows.join(per_capture, (F.col("url") == F.col("_url")) & (F.col("at") == F.col("_at")), "left").select(
        F.col("id").alias("page_id"),
        host(F.col("url")).alias("host"),
        "at",
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        F.col("n_active").isNotNull().alias("blocked"),
    )


def capture_days(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day (0 to 729) that follows from the id: the tables have none."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 7919, F.lit(730)).alias("at"))


def reported_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries that grow with the pages: each page is a report on its URL, host or domain."""
    turn = F.pmod(F.col("page_id"), F.lit(3))
    domain = F.regexp_replace(host(F.col("url")), r"^(?:www|m|blog)\.", "")
    return pages.select(
        F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), (F.pmod(F.floor(F.col("page_id") / 3), F.lit(3)) + 1).cast("int")).alias("list"),
        F.when(turn == 0, "url").when(turn == 1, "host").otherwise("domain").alias("kind"),
        F.when(turn == 0, location(F.col("url"))).when(turn == 1, host(F.col("url"))).otherwise(domain).alias("value"),
        F.pmod(F.col("page_id") * 104729, F.lit(730)).alias("at"),
        (F.pmod(F.floor(F.col("page_id") / 9), F.lit(2)) == 0).alias("active"),
    )


BLOCKED_SQL = r"""
WITH parsed AS (
  SELECT page_id, url, page_id * 7919 % 730 AS "at",
    nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.'), '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
events AS (
  SELECT list, kind, value, "at", bool_or(active) AS active FROM (
    SELECT ['adult', 'malware', 'spam'][(page_id // 3) % 3 + 1] AS list,
      ['url', 'host', 'domain'][page_id % 3 + 1] AS kind,
      CASE page_id % 3 WHEN 0 THEN host || path WHEN 1 THEN host
           ELSE regexp_replace(host, '^(?:www|m|blog)\.', '') END AS value,
      page_id * 104729 % 730 AS "at", (page_id // 9) % 2 = 0 AS active FROM parsed)
  GROUP BY ALL),
spans AS (SELECT *, lead("at") OVER (PARTITION BY list, kind, value ORDER BY "at") AS until FROM events),
keys AS (
  SELECT page_id, "at", 'url' AS kind, host || path AS value FROM parsed
  UNION ALL SELECT page_id, "at", 'host', host FROM parsed
  UNION ALL SELECT page_id, "at", 'domain', array_to_string(string_split(host, '.')[i:], '.')
  FROM parsed, LATERAL (SELECT unnest(range(1, len(string_split(host, '.')))) AS i)),
hits AS (
  SELECT k.page_id, count(*) AS n, string_agg(DISTINCT s.list, ',' ORDER BY s.list) AS lists
  FROM keys k JOIN spans s ON k.kind = s.kind AND k.value = s.value
   AND s."at" <= k."at" AND (s.until IS NULL OR k."at" < s.until)
  WHERE s.active GROUP BY k.page_id)
SELECT p.page_id, host, "at", coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked
FROM parsed p LEFT JOIN hits h ON p.page_id = h.page_id
"""
