"""URL filter lists joined as of the time of every capture, in DataFrame functions only.

Dated list entries ("from now on this key is blocked / allowed / no longer listed") become validity
intervals per list and key. A capture asks for its URL, its host and every parent domain, and is judged by
the entries active when it was fetched: the most specific key decides, and at equal depth an allow beats
a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.common import deal, fits_broadcast, read

#: Width of the time buckets that keep a key with very many entries from meeting all of its captures.
BUCKET_DAYS = 30
#: Interval rows that are broadcast; beyond, both sides are shuffled and keys of very many captures are split.
MAX_BROADCAST_INTERVALS = 200_000
#: Host of an absolute URL, without user and port.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of dated entries (list, key, entry_id, at, action): + valid_to, exclusive, null if open.

    An entry holds until the next one of its list and key; of entries at one moment the largest entry_id
    holds. Entries without key, time or action and ``remove`` entries open nothing.
    """
    own = Window.partitionBy("list", "key").orderBy("at", "entry_id")
    known = entries.where("key is not null and at is not null and action is not null")
    spans = known.select("list", "key", "entry_id", "at", "action", F.lead("at").over(own).alias("valid_to"))
    return spans.where("action <> 'remove' and (valid_to is null or valid_to > at)")


def judge(captures: DataFrame, entries: DataFrame, bucket_days: int = BUCKET_DAYS, max_broadcast: int = MAX_BROADCAST_INTERVALS) -> DataFrame:
    """Per capture (page_id, url, fetched_at): page_id, url, verdict (allow, block or none), key, list and entry_id.

    A page fetched at several times, or under several URLs, is judged once for each; rows that repeat a capture are one.
    Captures with a null or malformed URL or a null time get ``none``; an empty list leaves every capture at ``none``.
    """
    day = lambda c: F.floor(F.unix_timestamp(c) / (86400 * bucket_days)).cast("long")
    spans = intervals(entries)
    parts = F.split(host_of(), r"\.")
    depth = F.size(parts)
    suffixes = F.transform(
        F.when(host_of() != "", F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.array_join(F.slice(parts, i, depth), ".").alias("key"), (depth - i + 1).alias("depth")),
    )
    whole = F.array(F.struct(F.col("url").alias("key"), F.lit(1_000_000).alias("depth")))
    asked = captures.select(
        "page_id", "url", F.col("fetched_at").alias("t"), day(F.col("fetched_at")).alias("bucket"),
        F.explode_outer(F.when(F.col("url").isNotNull(), F.concat(suffixes, whole))).alias("k"),
    ).select("page_id", "url", "t", "bucket", "k.key", "k.depth")
    reach = captures.agg(F.min(day(F.col("fetched_at"))).alias("low"), F.max(day(F.col("fetched_at"))).alias("high"))
    low, high = reach.first()
    low, high = (0, -1) if low is None else (low, high)
    first, last = F.greatest(day(F.col("at")), F.lit(low)), F.least(F.coalesce(day(F.col("valid_to")), F.lit(high)), F.lit(high))
    dealt = spans.withColumn("bucket", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
    keys = ["key", "bucket"]
    if fits_broadcast(dealt, max_broadcast):
        dealt = F.broadcast(dealt)
    else:
        asked, dealt = deal(asked, dealt, keys, "part")
        keys.append("part")
    on = [asked[k] == dealt[k] for k in keys] + [asked["t"] >= dealt["at"], dealt["valid_to"].isNull() | (asked["t"] < dealt["valid_to"])]
    met = asked.join(dealt, on, "left").select(
        asked["page_id"], asked["url"], asked["t"], asked["depth"], dealt["action"], asked["key"], dealt["list"], dealt["entry_id"]
    )
    # of one key, an allow beats a block, then the newest entry decides
    weight = F.when(F.col("action").isNotNull(), F.struct("depth", (F.col("action") == "allow").cast("int").alias("allow"), "entry_id", "list"))
    best = F.max_by(F.struct("action", "key", "list", "entry_id"), weight)
    return met.groupBy("page_id", "url", "t").agg(best.alias("best")).select(
        "page_id", "url", F.coalesce("best.action", F.lit("none")).alias("verdict"), "best.key", "best.list", "best.entry_id"
    )


def demo_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time derived from page_id: five-minute slots of 120 days."""
    slot = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("long") % 34560
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + slot * 300).alias("fetched_at"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """Eight dated entries for every host and parent domain of the pages, on three lists."""
    known = pages.select(host_of().alias("host")).where("host <> ''").distinct()
    known = known.withColumn("parts", F.split("host", r"\."))
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("parts") - 1)), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))
    rows = known.select(F.explode(keys).alias("key")).distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7))))
    number = lambda salt, m: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(salt), "key", F.col("n").cast("string"))), 1, 8), 16, 10).cast("long") % m
    return rows.select(
        F.concat(F.lit("list"), (F.col("n") % 3).cast("string")).alias("list"), "key", (number("id", 1_000_000) * 8 + F.col("n")).alias("entry_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + number("at", 120) * 86400).alias("at"),
        F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), (number("do", 3) + 1).cast("int")).alias("action"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge`` of all pages by lists derived from their hosts; its docstring defines every case."""
    pages = read(spark, sf_dir, "pages")
    return judge(demo_captures(pages), demo_entries(pages))


SQL = rf"""
with h as (select page_id, url, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) as host,
    make_timestamp((1704067200 + (('0x' || substr(md5(cast(page_id as varchar)), 1, 8))::bigint % 34560) * 300) * 1000000) as t from pages),
known as (select distinct host, string_split(host, '.') as parts from h where host <> ''),
keys as (select distinct unnest(list_transform(range(1, greatest(1, len(parts) - 1) + 1), lambda i: array_to_string(parts[i:], '.'))) as key from known),
rows as (select key, unnest(range(0, 8)) as n from keys),
entries as (select 'list' || (n % 3) as list, key,
    (('0x' || substr(md5('id/' || key || '/' || n), 1, 8))::bigint % 1000000) * 8 + n as entry_id,
    make_timestamp((1704067200 + (('0x' || substr(md5('at/' || key || '/' || n), 1, 8))::bigint % 120) * 86400) * 1000000) as since,
    ['block', 'allow', 'remove'][('0x' || substr(md5('do/' || key || '/' || n), 1, 8))::bigint % 3 + 1] as action from rows),
spans as (select *, lead(since) over (partition by list, key order by since, entry_id) as valid_to from entries),
open as (select * from spans where action <> 'remove' and (valid_to is null or valid_to > since)),
asked as (select page_id, url, t, array_to_string(string_split(host, '.')[i:], '.') as key, len(string_split(host, '.')) - i + 1 as depth
    from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as i from h where host <> '')
  union all select page_id, url, t, url, 1000000 from h where url is not null),
met as (select page_id, url, t, action, a.key, list, entry_id,
    row_number() over (partition by page_id, url, t order by depth desc, (action = 'allow')::int desc, entry_id desc, list desc) as rn
  from asked a join open o on a.key = o.key and a.t >= o.since and (o.valid_to is null or a.t < o.valid_to))
select h.page_id, h.url, coalesce(action, 'none') as verdict, key, list, entry_id
from (select distinct page_id, url, t from h) h left join (select * from met where rn = 1) m
  on h.page_id is not distinct from m.page_id and h.url is not distinct from m.url and h.t = m.t
"""
