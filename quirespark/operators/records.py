"""Versioned records kept as a log of events, their retrieval and scores; ledgers and retention; gates over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events that make a record active or not; any other action is ignored.
ACTIONS = {"add": "active", "restore": "active", "revoke": "revoked", "delete": "deleted"}


def current_records(events: DataFrame, key: list[str], at: list[str], action: str = "action") -> DataFrame:
    """key, status, version, created_at, confirmed_at and the last values of each record, replayed from its events.

    Each event counts one version, the latest decides; deleted records and events with a null key are gone. Everything is
    one aggregate that combines before the shuffle, so a record of very many events is no hot group.
    """
    known = events.dropna(subset=[*key, *at]).where(F.col(action).isin(*ACTIONS))
    rest = [c for c in events.columns if c not in {*key, *at}]
    status = F.create_map(*[x for pair in ACTIONS.items() for x in map(F.lit, pair)])
    last = F.max(F.struct(*at, *rest))
    grouped = known.groupBy(*key).agg(F.count("*").alias("version"), F.min(at[0]).alias("created_at"), F.max(at[0]).alias("confirmed_at"), last.alias("l"))
    full = grouped.select(*key, status[F.col("l")[action]].alias("status"), "version", "created_at", "confirmed_at", *[F.col("l")[c].alias(c) for c in rest if c != action])
    return full.where("status <> 'deleted'")


def lookup(records: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """Active records whose ``on`` is among the wanted ones."""
    return records.where("status = 'active'").join(wanted.select(on).distinct(), on, "left_semi")


def scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` of record (r_) and context (c_) columns with score, reasons, needs_review, needs_adaptation.

    Fields: expression, domain, fingerprint, collocation, tags (array), pos, syntax, target. Basis points add up: expression
    4500 or 3000, domain 1000, fingerprint 2500 or else collocation 1000 and tags 500, pos, syntax, target and tags 500
    each, 10 000 at most. A null matches nothing.
    """
    same = lambda f: F.coalesce(F.col(f"r_{f}") == F.col(f"c_{f}"), F.lit(False))
    tags = F.coalesce(F.arrays_overlap("r_tags", "c_tags"), F.lit(False))
    rules: list[tuple[Column, int, str, str | None, int]] = [
        (same("expression"), 4500, "exact_expression", "caller_supplied_related_expression", 3000),
        (same("domain"), 1000, "same_domain", "domain_conflict", 0),
        (same("fingerprint"), 2500, "exact_context_fingerprint", None, 0),
        (~same("fingerprint") & same("collocation"), 1000, "same_core_collocation", None, 0),
        (~same("fingerprint") & tags, 500, "shared_semantic_tags", None, 0),
        (same("fingerprint") | same("collocation"), 0, "", "context_conflict", 0),
        (same("pos"), 500, "same_source_part_of_speech", "source_part_of_speech_changed", 0),
        (same("syntax"), 500, "same_source_syntax", "source_syntax_changed", 0),
        (same("target"), 500, "same_target_grammar_function", "target_grammar_function_changed", 0),
        (tags, 500, "semantic_support", "semantic_context_conflict", 0),
    ]
    score, reasons = F.lit(0), []
    for holds, points, reason, otherwise, rest in rules:
        score = score + F.when(holds, points).otherwise(rest)
        reasons.append(F.when(holds, F.lit(reason or None)).otherwise(F.lit(otherwise)))
    adapts = ~(same("pos") & same("syntax") & same("target"))
    review = adapts | ~same("domain") | ~(same("fingerprint") | same("collocation")) | ~tags
    return pairs.withColumns({"score": F.least(F.lit(10_000), score).cast("long"), "reasons": F.array_compact(F.array(*reasons)), "needs_review": review, "needs_adaptation": adapts})


def conflicts(records: DataFrame, expression: str, preferred: str) -> DataFrame:
    """``records`` with ``conflicting``: whether the expression has more than one preferred text.

    An aggregate and a join, not a window, so an expression of very many records is no hot group.
    """
    spread = records.groupBy(expression).agg((F.min(preferred) != F.max(preferred)).alias("conflicting"))
    return records.join(spread, expression).withColumn("conflicting", F.coalesce("conflicting", F.lit(False)))


def ledger(events: DataFrame, key: str, order: list[str], body: list[str]) -> DataFrame:
    """``events`` with seq, previous_hash and state_hash: each hash covers the event and all before it of its key."""
    item = F.struct(*order, *[c for c in body if c not in order])
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    hashed = F.aggregate(
        "items",
        F.array().cast("array<string>"),
        lambda done, e: F.concat(done, F.array(F.sha2(F.concat(F.coalesce(F.get(done, F.size(done) - 1), F.lit("")), F.to_json(F.struct(*[e[c].alias(c) for c in sorted(body)]), {"ignoreNullFields": "false"})), 256))),
    )
    each = rows.select(key, F.posexplode(F.arrays_zip(F.col("items").alias("e"), hashed.alias("h"))).alias("seq", "x"))
    full = each.select(key, F.col("seq").cast("long").alias("seq"), *[F.col("x.e")[c].alias(c) for c in dict.fromkeys([*order, *body])], F.col("x.h").alias("state_hash"))
    return full.withColumn("previous_hash", F.lag("state_hash").over(Window.partitionBy(key).orderBy("seq")))


def ledger_problems(stages: DataFrame, key: str, order: list[str], stage: str, ranks: list[str]) -> DataFrame:
    """key, seq, problem: stages that are unknown, or that do not follow the stage before by exactly one rank."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(stage))
    window = Window.partitionBy(key).orderBy(*order)
    own = stages.withColumn("rank_", rank).withColumn("seq", (F.row_number().over(window) - 1).cast("long"))
    before = F.coalesce(F.lag("rank_").over(window), F.lit(0))
    problem = F.when(F.coalesce(F.col("rank_"), F.lit(0)) == 0, "unknown").when(F.col("rank_") != before + 1, "order")
    return own.withColumn("problem", problem).where("problem is not null").select(key, "seq", "problem")


def expired(jobs: DataFrame, expires_at: str, now: Column) -> DataFrame:
    """Jobs to be cleaned: a job is kept only while it expires after now; without a time it is kept."""
    return jobs.where(F.col(expires_at) <= now)


def gates(frame: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, gate, passed, failures of each check over all rows of a key; a null check fails.

    All checks are one aggregate; the long form comes from its one row a key.
    """
    counted = frame.groupBy(key).agg(*[F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)).alias(n) for n, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), (F.col(n) == 0).alias("passed"), F.col(n).cast("long").alias("failures")) for n in checks])
    return counted.select(key, F.explode(rows).alias("g")).select(key, "g.gate", "g.passed", "g.failures")


def first_failure(ranked: dict[str, Column]) -> Column:
    """The name of the first check that does not hold, by the order given; null if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in ranked.items()])


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, in_a, in_b of the values that do not stand equally often in both."""
    tagged = a.select(*keys, F.lit(1).alias("a_"), F.lit(0).alias("b_")).unionByName(b.select(*keys, F.lit(0).alias("a_"), F.lit(1).alias("b_")))
    both = tagged.groupBy(*keys).agg(F.sum("a_").cast("long").alias("in_a"), F.sum("b_").cast("long").alias("in_b"))
    return both.where("in_a <> in_b")


def repeated_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of the keys that stand more than once."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``child`` without a row of ``parent`` of the same keys."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")
