"""URL filters as a temporal list join.

A list log has one row for each dated change: list, kind of rule (host, domain or url), rule, action (add or
remove), date of publication. Changes of one rule on one date fold into one (add wins); each then holds until
the next change of that rule, which gives validity intervals. A capture looks up its url, its host and the
domain of that host, and meets the entries whose interval holds its fetch time: an as-of join on equal rules.
A rule has as many intervals as its list was published, however often it is repeated, and the captures of a hot
host are dealt to parts, so no task holds all of them.

Defined results. A capture is its key, url and fetch time, so repeated keys are judged each at their own time and
captures without a key like others; rows equal in all three have the same result and stay repeated. A capture with a
null or unparsable url or a null fetch time meets nothing and is kept. Log rows with a null in any column are ignored.
An interval holds its start and not its end. An entry counts once for a capture even if the log repeats it. Urls of any
length are read whole. Empty tables: nothing is blocked. Other columns are carried along; a clash with the added ones
(``n_entries``, ``lists``, ``blocked``) or with a name that begins with ``_capture`` is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEME = r"^(?:[a-z][a-z0-9+.-]*:)?//"
#: The second-level labels below which country domains give out names.
SECOND_LEVEL = "ac|co|com|edu|go|gob|gov|gv|ltd|me|mil|ne|net|nhs|nom|or|org|plc|sch"
#: Domains of hosts that give out names below them to anybody.
HOSTED = [
    "appspot.com", "azurewebsites.net", "bitbucket.io", "blogspot.com", "cloudfront.net", "codeberg.page", "deno.dev", "firebaseapp.com",
    "fly.dev", "github.io", "gitlab.io", "glitch.me", "herokuapp.com", "hf.space", "myshopify.com", "neocities.org", "netlify.app", "onrender.com",
    "pages.dev", "readthedocs.io", "repl.co", "surge.sh", "tumblr.com", "vercel.app", "web.app", "weebly.com", "wixsite.com", "wordpress.com", "workers.dev",
]
_SUFFIX = rf"(?:{SECOND_LEVEL})\.[a-z]{{2}}|" + "|".join(h.replace(".", r"\.") for h in HOSTED)


def host_of(url):
    """The lower-case host without user, port and last dots, empty if there is none."""
    return F.regexp_extract(F.lower(url), SCHEME + r"(?:[^/?#]*@)?(\[[^/?#\]]*\]|[^/:?#]*?)\.*(?=[:/?#]|$)", 1)


def domain_of(host):
    """The name that was given out: the last two labels, three where the last two are such as co.uk or a host of
    ``HOSTED``; empty if the host has fewer, or is an address."""
    address = host.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$")
    return F.when(address, "").otherwise(F.regexp_extract(host, rf"(?:^|\.)([^.]+\.(?:{_SUFFIX})|(?!(?:{_SUFFIX})$)[^.]+\.[^.]+)$", 1))


def plain_url(url):
    """The url without scheme, user, fragment, default port, last dots of the host and last slash. The host is
    lower-case; a path keeps its case, as /A and /a are two pages. 80 is the default port of http and 443 that of https;
    without a scheme both are."""
    scheme = F.regexp_extract(F.lower(url), r"^([a-z][a-z0-9+.-]*)://", 1)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "(?i)" + SCHEME, ""), r"^[^/?#]*@", ""), "#.*$", "")
    place = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    http, https = F.regexp_replace(place, ":(80)?$", ""), F.regexp_replace(place, ":(443)?$", "")
    place = F.when(scheme == "http", http).when(scheme == "https", https).when(scheme == "", F.regexp_replace(place, ":(80|443)?$", "")).otherwise(place)
    place = F.regexp_replace(place, r"^([^:]*?)\.+(?=:|$)", "$1")
    return F.regexp_replace(F.concat(place, F.regexp_replace(rest, "^[^/?]*", "")), "/$", "")


def intervals(log: DataFrame) -> DataFrame:
    """(list, kind, rule, valid_from, valid_to) of the entries; valid_to is null while an entry holds."""
    named = log.dropna(subset=["list", "kind", "rule", "action", "published"])
    folded = named.groupBy("list", "kind", "rule", "published").agg(F.min("action").alias("action"))
    following = F.lead("published").over(Window.partitionBy("list", "kind", "rule").orderBy("published"))
    return folded.withColumn("valid_to", following).filter("action = 'add'").select("list", "kind", "rule", F.col("published").alias("valid_from"), "valid_to")


def active_entries(captures: DataFrame, log: DataFrame, key: str, url_col: str = "url", time_col: str = "fetched_at", salts: int = 64) -> DataFrame:
    """(key, url, time, list, kind, rule) of every capture and entry that was active when it was fetched."""
    host = host_of(F.col(url_col))
    asked = captures.select(
        F.struct(F.col(key).alias("key"), F.col(url_col).alias("url"), F.col(time_col).alias("at")).alias("capture"),
        F.explode(
            F.array(
                F.struct(F.lit("url").alias("kind"), plain_url(F.col(url_col)).alias("rule")),
                F.struct(F.lit("host").alias("kind"), host.alias("rule")),
                F.struct(F.lit("domain").alias("kind"), domain_of(host).alias("rule")),
            )
        ).alias("q"),
    ).select("capture", F.col("capture.at").alias("at"), "q.kind", "q.rule")
    # a hot host's captures are dealt to ``salts`` parts; an entry is copied to the parts that ask for its rule
    part = F.pmod(F.xxhash64("capture"), F.lit(salts))
    asked = asked.filter("rule is not null and rule <> ''").withColumn("part", part)
    wanted = asked.select("kind", "rule", "part").distinct()
    entry = wanted.join(intervals(log), ["kind", "rule"])
    held = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    met = asked.join(entry, ["kind", "rule", "part"]).filter(held).select("capture", "list", "kind", "rule").distinct()
    return met.select(F.col("capture.key").alias(key), F.col("capture.url").alias(url_col), F.col("capture.at").alias(time_col), "list", "kind", "rule")


def filter_urls(captures: DataFrame, log: DataFrame, key: str, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``n_entries`` (active entries met), ``lists`` (their lists, sorted) and ``blocked``."""
    own = {"_capture_key": key, "_capture_url": url_col, "_capture_at": time_col}
    if clash := {"n_entries", "lists", "blocked", *own} & set(captures.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; rename them")
    met = active_entries(captures.select(key, url_col, time_col), log, key, url_col, time_col).groupBy(*(F.col(c).alias(name) for name, c in own.items()))
    met = met.agg(F.count("*").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    equal = (captures[url_col] == F.col("_capture_url")) & (captures[time_col] == F.col("_capture_at")) & captures[key].eqNullSafe(F.col("_capture_key"))
    out = captures.join(met, equal, "left").drop(*own)
    return out.withColumns({"n_entries": F.coalesce("n_entries", F.lit(0)), "lists": F.coalesce("lists", F.lit("")), "blocked": F.col("n_entries").isNotNull()})


def captures_and_log(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures and a list log derived from ``pages``: every page was fetched at a second of two years, and
    some pages had their host, domain or url listed or delisted at one of the 25 monthly publications."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    captures = pages.withColumn("fetched_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (page_id * 7919) % 63072000)"))
    host = host_of(F.col("url"))
    kind = F.when(F.col("page_id") % 13 == 0, "url").when(F.col("page_id") % 11 == 0, "domain").when(F.col("page_id") % 5 == 0, "host")
    log = pages.select(
        F.when(F.col("page_id") % 2 == 0, "adult").otherwise("spam").alias("list"),
        kind.alias("kind"),
        F.when(kind == "url", plain_url(F.col("url"))).when(kind == "domain", domain_of(host)).otherwise(host).alias("rule"),
        F.when(F.col("page_id") % 3 == 0, "remove").otherwise("add").alias("action"),
        (start + F.expr("make_dt_interval(cast((page_id * 31) % 25 * 30 as int))")).alias("published"),
    ).filter("kind is not null")
    return captures, log


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """Whole ``pages``: what the lists said when each page was fetched."""
    captures, log = captures_and_log(spark, sf_dir)
    return filter_urls(captures, log, "page_id").select("page_id", "fetched_at", "n_entries", "lists", "blocked")


#: Written apart from the expressions above: urls are taken to pieces by splitting, and entries looked up as of the
#: fetch time by the last change of each rule instead of intervals.
OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + ((page_id * 7919) % 63072000) * INTERVAL '1' SECOND AS fetched_at,
    CASE WHEN left(url, 2) = '//' THEN 0 WHEN strpos(url, '://') > 1 THEN strpos(url, '://') END AS mark FROM pages),
rests AS (SELECT *, CASE WHEN mark IS NULL OR mark = 0 THEN '' ELSE lower(left(url, mark - 1)) END AS scheme,
    split_part(CASE WHEN mark IS NULL THEN url WHEN mark = 0 THEN substr(url, 3) ELSE substr(url, mark + 3) END, '#', 1) AS rest FROM parts),
sides AS (SELECT *, split_part(split_part(rest, '/', 1), '?', 1) AS authority FROM rests),
hosts AS (
  SELECT *, lower(string_split(authority, '@')[-1]) AS place, substr(rest, length(authority) + 1) AS path FROM sides),
ports AS (SELECT *, rtrim(split_part(place, ':', 1), '.') AS machine, substr(place, length(split_part(place, ':', 1)) + 1) AS port FROM hosts),
named AS (
  SELECT *, CASE WHEN mark IS NULL THEN '' ELSE machine END AS host,
    machine || CASE WHEN (port IN (':', ':80') AND scheme IN ('http', '')) OR (port IN (':', ':443') AND scheme IN ('https', '')) THEN '' ELSE port END || path AS whole FROM ports),
labels AS (
  SELECT *, string_split(host, '.') AS l, CASE WHEN right(whole, 1) = '/' THEN left(whole, length(whole) - 1) ELSE whole END AS plain FROM named),
both_keys AS (
  SELECT *, CASE WHEN len(l) < 2 OR (len(l) = 4 AND TRY_CAST(replace(host, '.', '') AS BIGINT) IS NOT NULL) THEN ''
      WHEN (length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'go', 'gob', 'gov', 'gv', 'ltd', 'me', 'mil', 'ne', 'net', 'nhs', 'nom', 'or', 'org', 'plc', 'sch')) OR l[-2] || '.' || l[-1] IN (HOSTED)
        THEN CASE WHEN len(l) > 2 THEN l[-3] || '.' || l[-2] || '.' || l[-1] ELSE '' END
      ELSE l[-2] || '.' || l[-1] END AS domain FROM labels),
log AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN 'adult' ELSE 'spam' END AS list,
    CASE WHEN page_id % 13 = 0 THEN 'url' WHEN page_id % 11 = 0 THEN 'domain' ELSE 'host' END AS kind,
    CASE WHEN page_id % 13 = 0 THEN plain WHEN page_id % 11 = 0 THEN domain ELSE host END AS rule,
    CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS added,
    TIMESTAMP '2024-01-01 00:00:00' + (((page_id * 31) % 25) * 30) * INTERVAL '1' DAY AS published
  FROM both_keys WHERE page_id % 13 = 0 OR page_id % 11 = 0 OR page_id % 5 = 0),
changes AS (SELECT list, kind, rule, published, max(added) AS added FROM log WHERE rule IS NOT NULL GROUP BY ALL),
asked AS (
  SELECT page_id, fetched_at, unnest([{'kind': 'url', 'rule': plain}, {'kind': 'host', 'rule': host}, {'kind': 'domain', 'rule': domain}], recursive := true) FROM both_keys),
met AS (
  SELECT a.page_id, c.list, c.kind, c.rule, arg_max(c.added, c.published) AS added
  FROM asked a JOIN changes c ON a.kind = c.kind AND a.rule = c.rule AND c.published <= a.fetched_at WHERE a.rule <> '' GROUP BY ALL),
said AS (SELECT page_id, count(*) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM met WHERE added = 1 GROUP BY page_id)
SELECT k.page_id, k.fetched_at, coalesce(s.n_entries, 0) AS n_entries, coalesce(s.lists, '') AS lists, s.n_entries IS NOT NULL AS blocked
FROM both_keys k LEFT JOIN said s ON k.page_id = s.page_id
""".replace("HOSTED", ", ".join(f"'{h}'" for h in HOSTED))
