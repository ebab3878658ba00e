"""URL filters that change over time.

A list is a log of dated entries: from its date on, an entry blocks, allows or no longer names a
pattern (a domain, or a host with the first segment of its path). Entries become validity
intervals, each ending where the pattern's next entry begins, and an as-of join evaluates every capture against
the entries that were active when it was fetched. Of the active ones the longest pattern decides.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bounded_share, materialise, small

#: Of entries that one pattern gets on one day, the later in this order holds.
ACTIONS = ("remove", "allow", "block")


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and a dot at the end; empty if there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(found, r"\.$", "")


def patterns(url: Column) -> Column:
    """The patterns that could name a URL: its domains of two labels and more, and host/segment."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[^:/?#]*://[^/?#]*/([^/?#]+)", 1)
    paths = F.when(segment != "", F.array(F.concat(host(url), F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host(url) != "", F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, since and until (null: still holds) of entries(pattern, action, dated).

    Rows with a null or an unknown action are ignored; repeated rows count once.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    day = entries.filter("pattern IS NOT NULL AND dated IS NOT NULL").filter(F.col("action").isin(*ACTIONS)).groupBy("pattern", "dated").agg(F.max_by("action", rank).alias("action"))
    until = F.lead("dated").over(Window.partitionBy("pattern").orderBy("dated"))
    return day.select("pattern", "action", F.col("dated").alias("since"), until.alias("until")).filter("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of captures(page_id, url, fetched): page_id, url, fetched, host, n_active,
    rule, action, since and blocked.

    n_active counts the active entries that name the capture, rule is the longest of them (of equals the
    last by code point). Captures without a host or a fetch time match nothing and aren't blocked. Repeated
    captures are each evaluated; columns beside the three are ignored. Without captures there are no rows.
    """
    spans = materialise(intervals(entries), "intervals")
    rows = materialise(captures.select("page_id", "url", "fetched").withColumn("row", F.monotonically_increasing_id()), "captures")  # row is fixed from here on
    asked = rows.withColumn("name", F.explode_outer(F.array_distinct(patterns(F.col("url")))))
    active = (F.col("name") == F.col("pattern")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    if (few := small(spans)) is not None:
        found = asked.join(few, active, "left")
    else:  # names that many captures ask for are told apart, so that none of them meets in one task
        uses = asked.groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
        share = bounded_share(int(uses.agg(F.sum("uses")).first()[0] or 0))
        often = F.broadcast(uses.filter((F.col("uses") > share) & F.col("name").isNotNull()).select(F.col("name").alias("_often")))  # 2,000 names at most
        hot = spans.join(often, F.col("pattern") == F.col("_often"), "left_semi")
        found = asked.join(often, F.col("name") == F.col("_often"), "left_semi").join(small(hot) or hot, active, "left").unionByName(
            asked.join(often, F.col("name") == F.col("_often"), "left_anti").join(spans, active, "left"))
    top = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("size"), F.col("pattern").alias("rule"), "action", "since"))).alias("top")
    found = found.groupBy("row", "page_id", "url", "fetched").agg(F.count("pattern").alias("n_active"), top)
    return found.select(
        "page_id", "url", "fetched", host(F.col("url")).alias("host"), "n_active", "top.rule", "top.action", "top.since",
        F.coalesce(F.col("top.action") == "block", F.lit(False)).alias("blocked"))


def keep(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures (page_id, url, fetched) that no active entry blocks; nulls, repeats and empty tables as in evaluate()."""
    return evaluate(captures, entries).filter("NOT blocked").select("page_id", "url", "fetched")
