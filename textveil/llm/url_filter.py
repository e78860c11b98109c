"""URL filters by a temporal list join, in DataFrame operations alone.

Dated entries of block and allow lists (add and remove, for a host or for a domain with all hosts
below it) become validity intervals: an entry's event holds from its date until the next event of the
same list and key. A capture is evaluated against the entries that were active when it was fetched:
its host and every parent domain are join keys, and the join's condition is that the interval holds
the fetch time. The most specific active key decides; on the same key an allow entry outranks a block.

Captures are first reduced to distinct pairs of host and fetch time, so a host with a third of all
captures joins once for each time. Domains that very many hosts share, such as a top-level one, are
keys of many pairs: each key is dealt into ``salts`` parts by the pair, and the intervals, a list that
is small beside the captures, are sent to every part. No side is broadcast by force.

Defined results: hosts and keys are compared in lower case, without a final dot, user or port. A null or relative URL has
no host and is not blocked; a null fetch time meets no interval. Events of one key at one time: a
removal outranks an addition, and repeated events count once. Entries with a null key, list or time
are no entries. Repeated captures get equal results, each its own row. An empty table of captures
gives an empty table; without entries nothing is blocked. Other columns of captures pass through,
whatever they are called, unless named like one of the result's own, which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textveil.llm.common import fresh


def host_of(url: Column) -> Column:
    """The host of an absolute URL, in lower case, or null."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def parents(host: Column) -> Column:
    """A host and all its parent domains, the host first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, key, exact, since, until)`` from events ``(list, key, exact, action, effective_at)``; ``until`` is null where it holds still.

    ``exact`` entries match their host alone, others a domain with all below.
    """
    known = entries.select("list", F.regexp_replace(F.lower("key"), r"\.+$", "").alias("key"), F.coalesce("exact", F.lit(False)).alias("exact"), "action", "effective_at")
    known = known.where("list is not null and key is not null and effective_at is not null and action in ('add', 'remove')")
    # One event for each time: 'remove' is the greater of the two words.
    known = known.groupBy("list", "key", "exact", "effective_at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "key", "exact").orderBy("effective_at")
    known = known.withColumn("until", F.lead("effective_at").over(order))
    return known.where("action = 'add'").select("list", "key", "exact", F.col("effective_at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", salts: int = 8) -> DataFrame:
    """``captures`` with ``host, blocked, matched_list, matched_key, matched_since`` as of each capture's time."""
    own = ["host", "blocked", "matched_list", "matched_key", "matched_since"]
    passed = [c for c in captures.columns if c not in own]
    host, best, met_host, met_time = (fresh(x, [*captures.columns, *own]) for x in ("own_host", "best", "met_host", "met_time"))
    captures = captures.withColumn(host, host_of(F.col(url_col)))
    places = captures.select(F.col(host).alias("host"), F.col(time_col).alias("time")).where("host is not null and time is not null").distinct()
    keys = places.select("host", "time", F.explode(parents(F.col("host"))).alias("key")).withColumn("salt", F.pmod(F.xxhash64("host", "time"), F.lit(salts)))
    spans = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    same = (keys["key"] == spans["key"]) & (keys["salt"] == spans["salt"])
    active = (keys["time"] >= spans["since"]) & (spans["until"].isNull() | (keys["time"] < spans["until"])) & (~spans["exact"] | (keys["key"] == keys["host"]))
    met = keys.join(spans, same & active).select("host", "time", "list", keys["key"], "exact", "since")
    # The longest key decides; on it an exact entry, then an allow entry, then the latest.
    rank = F.struct(F.length("key").alias("depth"), F.col("exact"), (F.col("list") == "allow").alias("allowed"), "since", "list", "key")
    decided = met.groupBy(F.col("host").alias(met_host), F.col("time").alias(met_time)).agg(F.max(rank).alias(best))
    result = captures.join(decided, (captures[host] == decided[met_host]) & (captures[time_col] == decided[met_time]), "left")
    return result.select(
        *(captures[c] for c in passed), captures[host].alias("host"), F.coalesce(~F.col(f"{best}.allowed"), F.lit(False)).alias("blocked"),
        F.col(f"{best}.list").alias("matched_list"), F.col(f"{best}.key").alias("matched_key"), F.col(f"{best}.since").alias("matched_since"),
    )
