"""Messages ``(channel, ...)`` routed to subscriptions ``(subscriber, channel, pattern)``.

A subscription has either a channel or a glob pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import strings
from corpusloom.operators.joins import salted_join


def _prefixes(channel: str):
    """All starts of a channel name, the empty one included."""
    name = F.col(channel)
    return F.explode(F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.substring(name, F.lit(1), n)))


def exact(subs: DataFrame) -> DataFrame:
    return subs.filter(F.col("channel").isNotNull()).select("subscriber", "channel").distinct()


def patterns(subs: DataFrame) -> DataFrame:
    return subs.filter(F.col("pattern").isNotNull()).select("subscriber", "pattern").distinct()


def pattern_channels(channels: DataFrame, subs: DataFrame) -> DataFrame:
    """Which pattern matches which channel: ``(channel, subscriber, pattern)``.

    A pattern meets a channel only if its literal start is a start of the
    channel, which is an equality join; the whole pattern is tested after it.
    """
    ready = patterns(subs).select(
        "subscriber",
        "pattern",
        strings.glob_prefix(F.col("pattern")).alias("_start"),
        strings.glob_column_regex(F.col("pattern")).alias("_regex"),
    )
    starts = channels.select("channel", _prefixes("channel").alias("_start"))
    return starts.join(ready, "_start").filter(F.expr("channel rlike _regex")).select("channel", "subscriber", "pattern")


def route(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """One delivery per matching exact subscription and per matching pattern subscription.

    Patterns are matched once per distinct channel, not per message.  A channel's
    messages are spread over salts.
    """
    by_name = exact(subs).select("channel", "subscriber", F.lit(None).cast("string").alias("pattern"))
    by_pattern = pattern_channels(messages.select("channel").distinct(), subs)
    hashable = [f.name for f in messages.schema if "map<" not in f.dataType.simpleString()]
    return salted_join(messages, by_name.unionByName(by_pattern), ["channel"], hashable)


def unsubscribe(subs: DataFrame, gone: DataFrame) -> DataFrame:
    """Subscriptions without those named in ``gone`` (same columns)."""
    same = (
        (F.col("s.subscriber") == F.col("g.subscriber"))
        & F.col("s.channel").eqNullSafe(F.col("g.channel"))
        & F.col("s.pattern").eqNullSafe(F.col("g.pattern"))
    )
    return subs.alias("s").join(gone.alias("g"), same, "left_anti")


def channel_stats(subs: DataFrame) -> DataFrame:
    """Subscribers per channel that has any."""
    return exact(subs).groupBy("channel").agg(F.count(F.lit(1)).alias("subscribers"))


def pattern_count(subs: DataFrame) -> DataFrame:
    """Number of pattern subscriptions."""
    return patterns(subs).agg(F.count(F.lit(1)).alias("patterns"))
