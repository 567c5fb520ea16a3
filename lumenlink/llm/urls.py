"""URL filters by a temporal list join, in DataFrame functions only.

Dated list entries (domain, kind, action, day) become validity intervals, and every capture is
evaluated against the entries active on the day of its fetch: an as-of join of each of the host's
parent domains with the intervals.  The longest active domain decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
#: Parts that the captures of one domain are dealt into; intervals are repeated for each.
SALT = 32


def host(url: Column) -> Column:
    """The host of an absolute URL in lower case; null where there is none."""
    got = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(got != "", got)


def domains(name: Column) -> Column:
    """The host and its parents of two labels or more; an IPv4 address or a single label stands alone."""
    labels = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(name.rlike(r"^[0-9.]+$") | (F.size(labels) < 2), F.array(name)).otherwise(parents)


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (domain, kind, action add or remove, day) -> validity intervals (domain, kind, since, until).

    An add holds from its day until the day of the next entry of the same domain and kind (until null: for
    good).  Of entries of one day an add outweighs a remove; equal entries count once.  Entries with
    a null domain, kind or day and other actions are passed over.
    """
    rows = entries.select(F.lower("domain").alias("domain"), "kind", "action", F.col("day").cast("date").alias("day"))
    rows = rows.where("domain is not null and kind is not null and day is not null and action in ('add', 'remove')")
    days = rows.groupBy("domain", "kind", "day").agg(F.max((F.col("action") == "add").cast("int")).alias("adds"))
    following = F.lead("day").over(W.partitionBy("domain", "kind").orderBy("day"))
    return days.withColumn("until", following).where("adds = 1").select("domain", "kind", F.col("day").alias("since"), "until")


def temporal_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (page_id, url, day) -> page_id, host, fetch_day, n_active, entry, kind, blocked.

    n_active counts the active intervals of the host and its parents; entry and kind are those of the
    longest active domain, of which block goes before allow by name; blocked says that it blocks.
    Captures without a host or a day match nothing.  Equal captures are judged alike, once each.

    Captures are reduced to distinct (host, day) first, and those of a domain are dealt into SALT
    parts, so neither a host nor a parent domain with very many captures meets in one task.
    """
    rows = captures.select(F.col("page_id"), host(F.col("url")).alias("host"), F.col("day").cast("date").alias("fetch_day"))
    asked = rows.where("host is not null and fetch_day is not null").select("host", "fetch_day").distinct()
    spread = asked.withColumn("domain", F.explode(domains(F.col("host")))).withColumn("part", F.pmod(F.xxhash64("host", "fetch_day"), F.lit(SALT)).cast("int"))
    valid = intervals(entries).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    during = (F.col("fetch_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetch_day") < F.col("until")))
    active = spread.join(valid, ["domain", "part"]).where(during)
    best = F.max_by(F.struct("domain", "kind"), F.struct(F.length("domain"), F.col("kind")))
    judged = active.groupBy("host", "fetch_day").agg(F.count(F.lit(1)).alias("n_active"), best.alias("best"))
    out = rows.join(judged, ["host", "fetch_day"], "left")
    return out.select("page_id", "host", "fetch_day", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("best.domain").alias("entry"), F.col("best.kind").alias("kind"), F.coalesce(F.col("best.kind") == "block", F.lit(False)).alias("blocked"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures; the table has no fetch day, so a rule of page_id gives one in 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Entries for domains that the pages show, by a rule of md5(domain): a fifth are listed, some are removed or listed again."""
    names = pages.select(host(F.col("url")).alias("host")).where("host is not null").distinct()
    names = names.select(F.explode(domains(F.col("host"))).alias("domain")).distinct()
    names = names.withColumn("x", F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("long")).where("x % 5 = 0")
    step = "array(struct('add' as action, 0 as shift), struct('remove' as action, if(x % 2 = 0, 90, 500) as shift), struct('add' as action, if(x % 3 = 0, 150, 600) as shift))"
    rows = names.select("domain", "x", F.explode(F.expr(step)).alias("e")).where("e.shift < 400")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("x") % 200 + F.col("e.shift")).cast("int"))
    return rows.select("domain", F.when(F.col("x") % 7 < 5, "block").otherwise("allow").alias("kind"), F.col("e.action").alias("action"), day.alias("day"))


URL_SQL = rf"""
WITH c AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS DATE) AS fetch_day FROM pages),
h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM c WHERE host IS NOT NULL),
s AS (
  SELECT host, unnest(CASE WHEN regexp_matches(host, '^[0-9.]+$') OR len(l) < 2 THEN [host] ELSE list_transform(range(1, len(l)), lambda i: array_to_string(l[i:], '.')) END) AS domain FROM h),
x AS (SELECT domain, CAST('0x' || substr(md5(domain), 1, 6) AS BIGINT) AS x FROM (SELECT DISTINCT domain FROM s)),
e AS (
  SELECT domain, CASE WHEN x % 7 < 5 THEN 'block' ELSE 'allow' END AS kind, action, CAST(DATE '2024-01-01' + CAST(x % 200 + shift AS INTEGER) AS DATE) AS day
  FROM (SELECT domain, x, 'add' AS action, 0 AS shift FROM x UNION ALL SELECT domain, x, 'remove', 90 FROM x WHERE x % 2 = 0 UNION ALL SELECT domain, x, 'add', 150 FROM x WHERE x % 3 = 0)
  WHERE x % 5 = 0),
i AS (SELECT *, lead(day) OVER (PARTITION BY domain, kind ORDER BY day) AS until FROM e),
a AS (
  SELECT c.page_id, c.host, c.fetch_day, i.domain, i.kind
  FROM c JOIN s ON c.host = s.host JOIN i ON i.domain = s.domain AND i.action = 'add' AND c.fetch_day >= i.day AND (i.until IS NULL OR c.fetch_day < i.until)),
b AS (
  SELECT page_id, count(*) AS n, arg_max(domain, (length(domain), kind)) AS entry, arg_max(kind, (length(domain), kind)) AS kind FROM a GROUP BY page_id)
SELECT c.page_id, c.host, c.fetch_day, coalesce(b.n, 0) AS n_active, b.entry, b.kind, coalesce(b.kind = 'block', false) AS blocked
FROM c LEFT JOIN b ON c.page_id = b.page_id
"""
