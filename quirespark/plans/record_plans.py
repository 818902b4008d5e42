"""Queries over logs of events, versioned records, ledgers and multisets.

The correction log's stand-in is events: user_id is the expression's owner, event_type the action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import intervals, records, topology
from quirespark.sources.documents import strict_json
from quirespark.sources.tables import table

ACTION = {"signup": "add", "purchase": "restore", "view": "add", "click": "revoke", "error": "delete"}
ACTION_SQL = "case event_type when 'signup' then 'add' when 'purchase' then 'restore' when 'view' then 'add' when 'click' then 'revoke' when 'error' then 'delete' end"
K_SQL = "cast(json_extract_string(props, '$.k') as bigint)"


def log(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, k, ts, event_id, action, value of the events as a log of records (user_id, k)."""
    action = F.create_map(*[x for pair in ACTION.items() for x in map(F.lit, pair)])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").select("user_id", k.alias("k"), "ts", "event_id", action.alias("action"), "value")


def current_records(spark: SparkSession, folder: str) -> DataFrame:
    return records.current_records(log(spark, folder), ["user_id", "k"], ["ts", "event_id"])


RECORDS_SQL = f"""
with l as (select user_id, {K_SQL} k, ts, event_id, {ACTION_SQL} act, value from events), g as (select user_id, k, count(*) as version, min(ts) created_at, max(ts) confirmed_at from l group by 1, 2),
r as (select * from l qualify row_number() over (partition by user_id, k order by ts desc, event_id desc) = 1)
select user_id, k, case when act in ('add', 'restore') then 'active' else 'revoked' end status, version, created_at, confirmed_at, value from g join r using (user_id, k) where act <> 'delete'
"""


def record_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Active records of the users who bought most (ten purchases or more)."""
    wanted = table(spark, folder, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 10")
    return records.lookup(current_records(spark, folder), wanted, "user_id").select("user_id", "k", "version", "value")


LOOKUP_SQL = f"select user_id, k, version, value from ({RECORDS_SQL}) where status = 'active' and user_id in (select user_id from events where event_type = 'purchase' group by 1 having count(*) >= 10)"


def record_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return records.conflicts(current_records(spark, folder).select("user_id", "k", "value"), "k", "value")


CONFLICTS_SQL = f"with r as ({RECORDS_SQL}) select user_id, k, value, coalesce(min(value) over (partition by k) <> max(value) over (partition by k), false) conflicting from r"


def record_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of the glossary as records against the terms of the same head word as contexts, scored."""
    own = table(spark, folder, "glossary").where("source is not null").withColumn("low", F.lower(F.trim("source")))
    fields = {"expression": F.col("low"), "domain": F.col("topic"), "fingerprint": F.xxhash64("low", "topic").cast("string"), "collocation": F.substring_index("low", " ", -1), "tags": F.split("low", " "), "pos": F.when(F.col("low").contains(" "), "phrase").otherwise("word"), "syntax": F.length("low").cast("string"), "target": F.length("target").cast("string")}
    r = own.select("term_id", *[c.alias(f"r_{n}") for n, c in fields.items()])
    c = own.select(F.col("term_id").alias("context_id"), *[c.alias(f"c_{n}") for n, c in fields.items()])
    pairs = r.join(c, F.col("r_collocation") == F.col("c_collocation")).where("term_id <> context_id")
    return records.scored(pairs).select("term_id", "context_id", "score", F.array_join("reasons", "|").alias("reasons"), "needs_review", "needs_adaptation")


SCORES_SQL = """
with g as (select term_id, lower(trim(source)) low, topic, target from glossary where source is not null),
f as (select *, string_split(low, ' ')[-1] head, string_split(low, ' ') tags, case when contains(low, ' ') then 'phrase' else 'word' end pos from g),
p as (select r.term_id, c.term_id context_id, r.low = c.low ex, coalesce(r.topic = c.topic, false) dom, r.low = c.low and r.topic is not distinct from c.topic fp, len(list_intersect(r.tags, c.tags)) > 0 tg, r.pos = c.pos ps, length(r.low) = length(c.low) sy, coalesce(length(r.target) = length(c.target), false) ta
  from f r join f c on r.head = c.head and r.term_id <> c.term_id)
select term_id, context_id, cast(least(10000, case when ex then 4500 else 3000 end + case when dom then 1000 else 0 end + case when fp then 2500 else 1000 + case when tg then 500 else 0 end end + case when ps then 500 else 0 end + case when sy then 500 else 0 end + case when ta then 500 else 0 end + case when tg then 500 else 0 end) as bigint) score,
  concat_ws('|', case when ex then 'exact_expression' else 'caller_supplied_related_expression' end, case when dom then 'same_domain' else 'domain_conflict' end, case when fp then 'exact_context_fingerprint' end, case when not fp then 'same_core_collocation' end, case when not fp and tg then 'shared_semantic_tags' end,
    case when ps then 'same_source_part_of_speech' else 'source_part_of_speech_changed' end, case when sy then 'same_source_syntax' else 'source_syntax_changed' end, case when ta then 'same_target_grammar_function' else 'target_grammar_function_changed' end, case when tg then 'semantic_support' else 'semantic_context_conflict' end) reasons,
  not ps or not sy or not ta or not dom or not tg needs_review, not ps or not sy or not ta needs_adaptation from p
"""


def ledger_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each user in time that do not go on by exactly one step of the five."""
    return records.ledger_problems(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type", ["signup", "view", "click", "purchase", "error"])


LEDGER_SQL = """
with r as (select user_id, ts, event_id, list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) rk from events),
w as (select user_id, row_number() over x - 1 as seq, rk, coalesce(lag(rk) over x, 0) b from r window x as (partition by user_id order by ts, event_id))
select user_id, seq, case when coalesce(rk, 0) = 0 then 'unknown' else 'order' end problem from w where coalesce(rk, 0) = 0 or rk <> b + 1
"""


def ledger_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The hash chain of each user's events; each hash covers all before it. Tested against a loop in Python."""
    own = table(spark, folder, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_id", "event_type")
    return records.ledger(own, "user_id", ["at", "event_id"], ["at", "event_id", "event_type"]).select("user_id", "seq", "state_hash", "previous_hash")


def retention_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose hour ended by noon of 30 January 2024: kept only while they expire later."""
    jobs = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n")).withColumn("expires_at", F.col("last_ts") + F.expr("interval 1 hour"))
    return records.expired(jobs, "expires_at", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


RETENTION_SQL = "select * from (select user_id, max(ts) last_ts, count(*) n, max(ts) + interval 1 hour expires_at from events group by 1) where expires_at <= timestamp '2024-01-30 12:00:00'"


def multiset_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of orders that stand unequally often as returned and as accepted, by part and supplier's digit."""
    own = table(spark, folder, "lineitem").select("l_partkey", (F.col("l_suppkey") % 10).alias("digit"), "l_returnflag")
    return records.multiset_difference(own.where("l_returnflag = 'R'").drop("l_returnflag"), own.where("l_returnflag = 'A'").drop("l_returnflag"), ["l_partkey", "digit"])


MULTISET_SQL = """
with r as (select l_partkey, l_suppkey % 10 digit, count(*) n from lineitem where l_returnflag = 'R' group by 1, 2), a as (select l_partkey, l_suppkey % 10 digit, count(*) n from lineitem where l_returnflag = 'A' group by 1, 2)
select l_partkey, digit, coalesce(r.n, 0) in_a, coalesce(a.n, 0) in_b from r full join a using (l_partkey, digit) where coalesce(r.n, 0) <> coalesce(a.n, 0)
"""


def gate_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Checks over the documents of each source: one row a gate, passed if no document fails it."""
    checks = {"has_text": F.col("text").isNotNull() & (F.length(F.trim("text")) > 0), "counted": F.col("n_chars") == F.length("text"), "language": F.col("lang").isin("en", "zh", "fr", "de", "es"), "in_time": F.col("loaded_at") >= F.col("published_at")}
    return records.gates(table(spark, folder, "documents"), "source", checks)


GATES_SQL = """
with c as (select source, text is not null and length(trim(text, ' ')) > 0 has_text, n_chars = length(text) counted, lang in ('en', 'zh', 'fr', 'de', 'es') as language, loaded_at >= published_at in_time from documents),
l as (select source, unnest(['has_text', 'counted', 'language', 'in_time']) gate, unnest([has_text, counted, language, in_time]) ok from c)
select source, gate, sum(case when coalesce(ok, false) then 0 else 1 end) = 0 passed, cast(sum(case when coalesce(ok, false) then 0 else 1 end) as bigint) failures from l group by 1, 2
"""


def repeated_line_keys(spark: SparkSession, folder: str) -> DataFrame:
    return records.repeated_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


KEYS_SQL = "select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1"


def orphan_renderings(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered renderings without a heading or body unit of theirs, and units without a delivered rendering."""
    own = table(spark, folder, "semantic_unit").where("role in ('heading', 'body')").select("doc_id", F.col("id").alias("unit_id")).distinct()
    other = table(spark, folder, "annotation_index").where("target_text is not null").select("doc_id", "unit_id").distinct()
    a = records.orphans(other, own, ["doc_id", "unit_id"]).withColumn("lacks", F.lit("unit"))
    return a.unionByName(records.orphans(own, other, ["doc_id", "unit_id"]).withColumn("lacks", F.lit("rendering")))


ORPHANS_SQL = """
(select doc_id, unit_id, 'unit' lacks from annotation_index where target_text is not null except select doc_id, id, 'unit' from semantic_unit where role in ('heading', 'body'))
union all (select doc_id, id, 'rendering' from semantic_unit where role in ('heading', 'body') except select doc_id, unit_id, 'rendering' from annotation_index where target_text is not null)
"""


def last_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """For each error the second of the user's last purchase up to then, give or take a minute."""
    own = table(spark, folder, "events").withColumn("s", F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1_000_000).cast("long")))
    marks = own.where("event_type = 'purchase'").select("user_id", F.col("s").alias("bought_s"))
    return intervals.as_of(own.where("event_type = 'error'").select("user_id", "event_id", "s"), marks, ["user_id"], "s", "bought_s", 60)


PURCHASES_SQL = """
with e as (select user_id, event_id, event_type, epoch_us(ts) // 1000000 s from events)
select user_id, event_id, s, (select max(p.s) from e p where p.event_type = 'purchase' and p.user_id = e.user_id and p.s <= e.s + 60) bought_s from e where event_type = 'error'
"""


def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Properties of events by a fixed schema; a text that is no such object gives null."""
    own = strict_json(table(spark, folder, "events"), "props", "k long").withColumn("p", F.when(~F.col("bad"), F.col("value")))
    return own.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))


PROPERTIES_SQL = f"select {K_SQL} k, count(*) n, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) errors from events group by 1"


def nearest_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """The number of the anchor of its page that is nearest to each line's left edge."""
    from quirespark.plans.page_plans import PAGE, lines

    own = lines(spark, folder, "x0")
    found = topology.column_anchors(own, PAGE, 2000, 20_000)
    return own.join(found, PAGE).select("doc_id", "id", topology.nearest_anchor(F.col("x0"), F.col("anchors")).alias("anchor"))


QUERIES = {f.__name__: f for f in (current_records, record_lookup, record_conflicts, record_scores, ledger_problems, ledger_hashes, retention_sweep, multiset_differences, gate_summary, repeated_line_keys, orphan_renderings, last_purchases, event_properties, nearest_anchors)}
SQL = {
    "current_records": RECORDS_SQL, "record_lookup": LOOKUP_SQL, "record_conflicts": CONFLICTS_SQL, "record_scores": SCORES_SQL, "ledger_problems": LEDGER_SQL, "retention_sweep": RETENTION_SQL, "multiset_differences": MULTISET_SQL,
    "gate_summary": GATES_SQL, "repeated_line_keys": KEYS_SQL, "orphan_renderings": ORPHANS_SQL, "last_purchases": PURCHASES_SQL, "event_properties": PROPERTIES_SQL,
}
