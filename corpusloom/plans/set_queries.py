"""Set, sorted-set, list and hash queries.

Sets come from events: the key is the event type, a member is a user on a day
of the month, and its score the sum of the values.  Lists are conversations,
hashes are parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import keys, lists, sets, zsets
from corpusloom.plans.registry import query, table

_SETS = "(SELECT DISTINCT event_type AS key, user_id || ':' || day(ts) AS member FROM events)"
_ZSETS = """(SELECT event_type AS key, user_id || ':' || day(ts) AS member, round(sum(value), 2) AS score FROM events GROUP BY 1, 2)"""


def member():
    return F.concat_ws(":", F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string"))


def event_sets(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("key"), member().alias("member")).distinct()


def event_zsets(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("key"), member().alias("member"), "value")
    return rows.groupBy("key", "member").agg(F.round(F.sum("value"), 2).alias("score"))


def _of(key: str, source: str = _SETS) -> str:
    return f"SELECT member FROM {source} WHERE key = '{key}'"


@query("sinter", f"{_of('view')} INTERSECT {_of('click')} INTERSECT {_of('purchase')}")
def sinter(spark, sf):
    return sets.sinter(event_sets(spark, sf), ["view", "click", "purchase"])


@query("sinter_absent_key", f"{_of('view')} INTERSECT {_of('nothing')}")
def sinter_absent_key(spark, sf):
    return sets.sinter(event_sets(spark, sf), ["view", "nothing"])


@query("sunion", f"{_of('view')} UNION {_of('error')} UNION {_of('nothing')}")
def sunion(spark, sf):
    return sets.sunion(event_sets(spark, sf), ["view", "error", "nothing"])


@query("sdiff", f"{_of('view')} EXCEPT {_of('click')} EXCEPT {_of('error')}")
def sdiff(spark, sf):
    return sets.sdiff(event_sets(spark, sf), ["view", "click", "error"])


@query("sdiff_store", f"SELECT key, member FROM {_SETS} WHERE key <> 'signup' UNION ALL SELECT 'signup', member FROM ({_of('view')} EXCEPT {_of('click')})")
def sdiff_store(spark, sf):
    all_sets = event_sets(spark, sf)
    return sets.store(all_sets, "signup", sets.sdiff(all_sets, ["view", "click"]))


@query(
    "set_add_remove",
    f"""SELECT DISTINCT key, member FROM (SELECT key, member FROM {_SETS} UNION ALL
      SELECT 'paid', user_id || ':' || day(ts) FROM events WHERE event_type = 'purchase') s
    WHERE NOT EXISTS (SELECT 1 FROM {_SETS} e WHERE e.key = 'error' AND s.key = 'view' AND s.member = e.member)""",
)
def set_add_remove(spark, sf):
    """Purchases added to a new set; members with errors removed from the views."""
    base = event_sets(spark, sf)
    added = sets.sadd(base, base.filter("key = 'purchase'").withColumn("key", F.lit("paid")))
    return sets.srem(added, base.filter("key = 'error'").withColumn("key", F.lit("view")))


@query("set_move", f"SELECT DISTINCT CASE WHEN key = 'view' AND member = '7:3' THEN 'click' ELSE key END AS key, member FROM {_SETS}")
def set_move(spark, sf):
    return sets.smove(event_sets(spark, sf), "view", "click", "7:3")


@query(
    "set_is_member",
    f"""SELECT u.key, u.member, CASE WHEN s.member IS NULL THEN 0 ELSE 1 END::BIGINT AS found
    FROM (SELECT DISTINCT 'view' AS key, user_id || ':' || day(ts) AS member FROM events) u LEFT JOIN {_SETS} s USING (key, member)""",
)
def set_is_member(spark, sf):
    asked = event_sets(spark, sf).select(F.lit("view").alias("key"), "member").distinct()
    return sets.is_member(event_sets(spark, sf), asked)


@query("set_sizes", "SELECT event_type AS key, count(DISTINCT user_id || ':' || day(ts)) AS size FROM events GROUP BY 1")
def set_sizes(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("key"), member().alias("member"))
    return sets.scard(rows)


_DRAWN = f"SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY md5(member || '#3'), member) AS r FROM {_SETS}"


@query("sample_n", f"SELECT key, member FROM ({_DRAWN}) WHERE r <= 25")
def sample_n(spark, sf):
    return sets.sample(event_sets(spark, sf), 25, seed=3)


@query("set_pop_rest", f"SELECT key, member FROM ({_DRAWN}) WHERE r > 25")
def set_pop_rest(spark, sf):
    return sets.spop(event_sets(spark, sf), 25, seed=3)[1]


@query(
    "sample_with_replacement",
    f"""WITH d AS ({_DRAWN}), n AS (SELECT key, count(*) AS n FROM d GROUP BY key),
    t AS (SELECT key, CAST(i AS INTEGER) AS draw, n, md5(key || '|' || i || '#3') AS h FROM n, range(1, 41) g(i))
    SELECT t.key, draw, member FROM t JOIN d ON d.key = t.key AND d.r - 1 = CAST('0x' || substr(h, 1, 12) AS BIGINT) % n""",
)
def sample_with_replacement(spark, sf):
    return sets.sample(event_sets(spark, sf), 40, replace=True, seed=3)


# Sorted sets --------------------------------------------------------------------


@query(
    "zunion_weighted",
    f"""SELECT member, round(sum(score * CASE key WHEN 'view' THEN 2.0 ELSE 3.5 END), 4) AS score
    FROM {_ZSETS} WHERE key IN ('view', 'click') GROUP BY member""",
)
def zunion_weighted(spark, sf):
    made = zsets.zcombine(event_zsets(spark, sf), ["view", "click"], [2.0, 3.5])
    return made.select("member", F.round("score", 4).alias("score"))


@query("zunion_max", f"SELECT member, max(score) AS score FROM {_ZSETS} WHERE key IN ('view', 'error', 'signup') GROUP BY member")
def zunion_max(spark, sf):
    return zsets.zcombine(event_zsets(spark, sf), ["view", "error", "signup"], aggregate="max")


@query(
    "zinter_min",
    f"SELECT member, min(score) AS score FROM {_ZSETS} WHERE key IN ('view', 'click', 'purchase') GROUP BY member HAVING count(*) = 3",
)
def zinter_min(spark, sf):
    return zsets.zcombine(event_zsets(spark, sf), ["view", "click", "purchase"], aggregate="min", mode="inter")


@query(
    "zunion_plain_set",
    f"""SELECT member, round(sum(s), 4) AS score FROM (SELECT member, score * 1.5 AS s FROM {_ZSETS} WHERE key = 'view'
      UNION ALL SELECT member, 10.0 FROM {_SETS} WHERE key = 'click') GROUP BY member""",
)
def zunion_plain_set(spark, sf):
    """A plain set takes part with score 1."""
    plain = event_sets(spark, sf).filter("key = 'click'").withColumn("score", F.lit(None).cast("double"))
    both = event_zsets(spark, sf).filter("key = 'view'").unionByName(plain)
    return zsets.zcombine(both, ["view", "click"], [1.5, 10.0]).select("member", F.round("score", 4).alias("score"))


_RANKED = f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM {_ZSETS}"


@query("zrank", f"SELECT key, member, score, rank FROM ({_RANKED})")
def zrank(spark, sf):
    return zsets.zrank(event_zsets(spark, sf))


@query("zrank_bucketed", f"SELECT key, member, score, rank FROM ({_RANKED})")
def zrank_bucketed(spark, sf):
    """The same ranks with each key cut into buckets, as it happens on large tables."""
    return zsets.zrank(event_zsets(spark, sf), buckets=16)


@query("zrevrank", f"SELECT key, member, score, n - 1 - rank AS rank FROM ({_RANKED})")
def zrevrank(spark, sf):
    return zsets.zrank(event_zsets(spark, sf), reverse=True)


@query("zrevrange_topk", f"SELECT key, member, score, n - 1 - rank AS rank FROM ({_RANKED}) WHERE n - 1 - rank <= 9")
def zrevrange_topk(spark, sf):
    return zsets.zrange(event_zsets(spark, sf), 0, 9, reverse=True)


@query("zrange_from_end", f"SELECT key, member, score, rank FROM ({_RANKED}) WHERE rank BETWEEN n - 50 AND n - 11")
def zrange_from_end(spark, sf):
    return zsets.zrange(event_zsets(spark, sf), -50, -11)


@query("zrange_by_score", f"SELECT key, member, score FROM {_ZSETS} WHERE score > 20 AND score <= 45.5")
def zrange_by_score(spark, sf):
    return zsets.zrange_by_score(event_zsets(spark, sf), 20, 45.5, low_open=True)


@query(
    "zrevrange_by_score_page",
    f"""SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS r
      FROM {_ZSETS} WHERE score >= 10 AND score <= 60) WHERE r BETWEEN 6 AND 25""",
)
def zrevrange_by_score_page(spark, sf):
    return zsets.zrange_by_score(event_zsets(spark, sf), 10, 60, offset=5, count=20, reverse=True)


@query("zrange_by_lex", "SELECT 'names' AS key, c_name AS member, CAST(0 AS DOUBLE) AS score FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000900'")
def zrange_by_lex(spark, sf):
    names = table(spark, sf, "customer").select(F.lit("names").alias("key"), F.col("c_name").alias("member"), F.lit(0.0).alias("score"))
    return zsets.zrange_by_lex(names, "[Customer#000000100", "(Customer#000000900")


@query("zcount", f"SELECT key, count(*) FILTER (score BETWEEN 15 AND 30) AS count FROM {_ZSETS} GROUP BY key")
def zcount(spark, sf):
    return zsets.zcount(event_zsets(spark, sf), zsets.score_between(15, 30))


@query("zlexcount", f"SELECT key, count(*) FILTER (member > '12' AND member <= '77') AS count FROM {_ZSETS} GROUP BY key")
def zlexcount(spark, sf):
    return zsets.zcount(event_zsets(spark, sf), zsets.lex_between("(12", "[77"))


_NEWER = "(SELECT 'view' AS key, user_id || ':' || day(ts) AS member, arg_max(value, event_id) AS score FROM events WHERE event_type = 'click' GROUP BY 2)"


def _changes(spark, sf):
    """Clicks as new scores of the views."""
    clicks = table(spark, sf, "events").filter("event_type = 'click'")
    return clicks.select(F.lit("view").alias("key"), member().alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))


@query(
    "zadd",
    f"SELECT key, member, coalesce(c.score, z.score) AS score FROM {_ZSETS} z FULL JOIN {_NEWER} c USING (key, member)",
)
def zadd(spark, sf):
    return zsets.zadd(event_zsets(spark, sf), _changes(spark, sf))


@query(
    "zadd_present_only",
    f"SELECT key, member, coalesce(c.score, z.score) AS score FROM {_ZSETS} z LEFT JOIN {_NEWER} c USING (key, member)",
)
def zadd_present_only(spark, sf):
    return zsets.zadd(event_zsets(spark, sf), _changes(spark, sf), "xx")


@query(
    "zadd_increment",
    f"""SELECT key, member, round(sum(score), 4) AS score FROM (SELECT * FROM {_ZSETS} UNION ALL
      SELECT 'view', user_id || ':' || day(ts), value FROM events WHERE event_type = 'click') GROUP BY key, member""",
)
def zadd_increment(spark, sf):
    made = zsets.zadd(event_zsets(spark, sf), _changes(spark, sf), "incr")
    return made.select("key", "member", F.round("score", 4).alias("score"))


@query(
    "zadd_changed_counts",
    f"""SELECT key, count(*) FILTER (z.score IS NULL) AS added,
      count(*) FILTER (z.score IS NOT NULL AND c.score IS NOT NULL AND c.score <> z.score) AS changed
    FROM {_ZSETS} z FULL JOIN {_NEWER} c USING (key, member) GROUP BY key""",
)
def zadd_changed_counts(spark, sf):
    return zsets.zadd_changed(event_zsets(spark, sf), _changes(spark, sf))


@query(
    "zscore_lookup",
    f"SELECT key, member, score FROM (SELECT 'view' AS key, member FROM {_SETS} WHERE key = 'click') LEFT JOIN {_ZSETS} z USING (key, member)",
)
def zscore_lookup(spark, sf):
    asked = event_sets(spark, sf).filter("key = 'click'").select(F.lit("view").alias("key"), "member")
    return zsets.zscore(event_zsets(spark, sf), asked).select("key", "member", "score")


@query("zrem_by_rank", f"SELECT key, member, score FROM ({_RANKED}) WHERE rank < 10 OR rank > n - 6")
def zrem_by_rank(spark, sf):
    return zsets.zrem_range_by_rank(event_zsets(spark, sf), 10, -6)


@query("zrem_by_score", f"SELECT key, member, score FROM {_ZSETS} WHERE NOT (score >= 12.5 AND score < 40)")
def zrem_by_score(spark, sf):
    return zsets.zrem_range(event_zsets(spark, sf), zsets.score_between(12.5, 40, high_open=True))


@query("zrem_by_lex", f"SELECT key, member, score FROM {_ZSETS} WHERE NOT member > '5'")
def zrem_by_lex(spark, sf):
    return zsets.zrem_range(event_zsets(spark, sf), zsets.lex_between("(5", "+"))


@query("zrem_members", f"SELECT key, member, score FROM {_ZSETS} WHERE (key, member) NOT IN (SELECT 'view', member FROM {_SETS} WHERE key = 'error')")
def zrem_members(spark, sf):
    gone = event_sets(spark, sf).filter("key = 'error'").withColumn("key", F.lit("view"))
    return zsets.zrem(event_zsets(spark, sf), gone)


# Lists --------------------------------------------------------------------------

_LISTS = "(SELECT conv_id AS key, turn AS pos, role AS value FROM conversations)"
_INDEXED = f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS index, count(*) OVER (PARTITION BY key) AS n FROM {_LISTS}"


def turn_lists(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("value")
    )


@query("list_range", f"SELECT key, pos, value, index FROM ({_INDEXED}) WHERE index BETWEEN 1 AND 3")
def list_range(spark, sf):
    return lists.lrange(turn_lists(spark, sf), 1, 3)


@query("list_trim", f"SELECT key, pos, value FROM ({_INDEXED}) WHERE index BETWEEN greatest(n - 4, 0) AND n - 2")
def list_trim(spark, sf):
    return lists.ltrim(turn_lists(spark, sf), -4, -2)


@query("list_index", f"SELECT key, pos, value, -2::BIGINT AS index FROM ({_INDEXED}) WHERE index = n - 2")
def list_index(spark, sf):
    return lists.lindex(turn_lists(spark, sf), -2)


@query("list_sizes", f"SELECT key, count(*) AS size FROM {_LISTS} GROUP BY key")
def list_sizes(spark, sf):
    return lists.llen(turn_lists(spark, sf))


@query(
    "list_remove",
    f"""SELECT key, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos DESC) AS r FROM {_LISTS})
    WHERE NOT (value = 'user' AND r <= 2)""",
)
def list_remove(spark, sf):
    return lists.lrem(turn_lists(spark, sf), "user", -2)


@query(
    "list_insert",
    f"""WITH p AS (SELECT key, min(pos) AS spot FROM {_LISTS} WHERE value = 'assistant' GROUP BY key)
    SELECT key, pos + CASE WHEN pos > spot THEN 1 ELSE 0 END AS pos, value FROM {_LISTS} LEFT JOIN p USING (key)
    UNION ALL SELECT key, spot + 1, 'note' FROM p""",
)
def list_insert(spark, sf):
    return lists.linsert(turn_lists(spark, sf), "assistant", "note", before=False)


@query("list_set", f"SELECT key, pos, CASE WHEN index = n - 1 THEN 'last' ELSE value END AS value FROM ({_INDEXED})")
def list_set(spark, sf):
    return lists.lset(turn_lists(spark, sf), -1, F.lit("last"))


@query("list_pop", f"SELECT key, pos, value, (n - index)::INTEGER AS nth FROM ({_INDEXED}) WHERE index >= n - 2")
def list_pop(spark, sf):
    return lists.pop(turn_lists(spark, sf), 2, "right")[0]


@query("list_pop_rest", f"SELECT key, pos, value FROM ({_INDEXED}) WHERE index >= 2")
def list_pop_rest(spark, sf):
    return lists.pop(turn_lists(spark, sf), 2, "left")[1]


@query(
    "list_push",
    f"""SELECT key, pos, value FROM {_LISTS} UNION ALL
    SELECT user_id, coalesce(l.first, 0) - 1 - (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1), event_type
    FROM events LEFT JOIN (SELECT key, min(pos) AS first FROM {_LISTS} GROUP BY key) l ON l.key = user_id""",
)
def list_push(spark, sf):
    """Events pushed to the left of the conversation with the user's number."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return lists.push(turn_lists(spark, sf), rows, "left")


@query(
    "list_push_existing",
    f"""SELECT key, pos, value FROM {_LISTS} UNION ALL
    SELECT user_id, l.last + row_number() OVER (PARTITION BY user_id ORDER BY event_id), event_type
    FROM events JOIN (SELECT key, max(pos) AS last FROM {_LISTS} GROUP BY key) l ON l.key = user_id""",
)
def list_push_existing(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return lists.push(turn_lists(spark, sf), rows, "right", only_existing=True)


_TYPES = "(SELECT event_type AS key, event_id AS pos, user_id AS value FROM events)"


@query(
    "list_rotate",
    f"""SELECT CASE WHEN key = 'view' AND pos = (SELECT max(pos) FROM {_TYPES} WHERE key = 'view') THEN 'click' ELSE key END AS key,
      CASE WHEN key = 'view' AND pos = (SELECT max(pos) FROM {_TYPES} WHERE key = 'view')
        THEN (SELECT min(pos) FROM {_TYPES} WHERE key = 'click') - 1 ELSE pos END AS pos, value FROM {_TYPES}""",
)
def list_rotate(spark, sf):
    """The last view moves to the head of the clicks; each event type is a list of events."""
    items = table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("pos"), F.col("user_id").alias("value"))
    return lists.rotate(items, "view", "click")


# Hashes -------------------------------------------------------------------------

_FIELDS = {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "CAST(p_size AS VARCHAR)"}
_HASHES = "(" + " UNION ALL ".join(f"SELECT 'part:' || p_partkey AS key, '{n}' AS field, {e} AS value FROM part" for n, e in _FIELDS.items()) + ")"


def part_hashes(spark, sf):
    wide = table(spark, sf, "part").select(
        F.concat(F.lit("part:"), "p_partkey").alias("key"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_size").cast("string").alias("size"),
    )
    return wide.unpivot(["key"], ["name", "brand", "type", "size"], "field", "value")


@query("hash_getall", f"SELECT key, field, value FROM {_HASHES}")
def hash_getall(spark, sf):
    return keys.hgetall(part_hashes(spark, sf))


@query(
    "hash_lookup",
    f"""SELECT a.ord, a.key, a.field, h.value FROM (SELECT l_orderkey * 10 + l_linenumber AS ord, 'part:' || (l_partkey + 5) AS key,
      CASE WHEN l_tax > 0.04 THEN 'brand' ELSE 'colour' END AS field FROM lineitem) a LEFT JOIN {_HASHES} h USING (key, field)""",
)
def hash_lookup(spark, sf):
    """A field asked for per order line; unknown parts and fields give null."""
    asked = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.lit("part:"), F.col("l_partkey") + 5).alias("key"),
        F.when(F.col("l_tax") > 0.04, "brand").otherwise("colour").alias("field"),
    )
    return keys.lookup(part_hashes(spark, sf), asked, ("key", "field")).select("ord", "key", "field", "value")


@query("hash_fields", "SELECT 'part:' || p_partkey AS key, CAST(4 AS BIGINT) AS size FROM part")
def hash_fields(spark, sf):
    return keys.hlen(part_hashes(spark, sf))


@query(
    "hash_set_absent",
    f"""SELECT key, field, value FROM {_HASHES} UNION ALL SELECT 'part:' || l_partkey, 'flag', arg_min(l_returnflag, l_orderkey * 100000000 + l_extendedprice)
    FROM lineitem GROUP BY l_partkey""",
)
def hash_set_absent(spark, sf):
    """The first order line of a part sets its flag; names that exist already stay."""
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("part:"), "l_partkey").alias("key"),
        F.explode(F.array(F.lit("flag"), F.lit("name"))).alias("field"),
        F.col("l_returnflag").alias("value"),
        (F.col("l_orderkey") * 100000000 + F.col("l_extendedprice")).alias("seq"),
    )
    used = part_hashes(spark, sf)
    known = lines.join(used.select("key").distinct(), "key", "left_semi")
    return keys.hset(used, known, "nx")


@query("hash_delete", f"SELECT key, field, value FROM {_HASHES} WHERE NOT (field = 'size' AND key IN (SELECT 'part:' || p_partkey FROM part WHERE p_size > 25))")
def hash_delete(spark, sf):
    gone = table(spark, sf, "part").filter("p_size > 25").select(F.concat(F.lit("part:"), "p_partkey").alias("key"), F.lit("size").alias("field"))
    return keys.hdel(part_hashes(spark, sf), gone)


@query("hash_scan", f"SELECT key, field, value FROM {_HASHES} WHERE regexp_matches(field, '^[n-t].*e$')")
def hash_scan(spark, sf):
    return keys.scan(part_hashes(spark, sf), "[n-t]*e", "field")
