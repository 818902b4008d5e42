"""Checks of renderings against their sources, and what they leave unresolved."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.markers import EXTRACTORS, agree
from quirespark.functions.text import compact, marker_text

ISSUE = pa.schema([("doc_id", pa.string()), ("unit_id", pa.string()), ("category", pa.string()), ("source_markers", pa.list_(pa.string())), ("target_markers", pa.list_(pa.string()))])


def mechanical_check(pairs: DataFrame, categories: tuple[str, ...] = tuple(EXTRACTORS)) -> DataFrame:
    """doc_id, unit_id, category, source_markers, target_markers of each category that a rendering does not keep.

    ``pairs``: doc_id, unit_id, source_text, target_text. A null text counts as empty, so its markers are missing. Each pair
    is searched in one Arrow batch; there is no shuffle.
    """
    clean = pairs.select("doc_id", "unit_id", *[marker_text(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("source_text", "target_text")])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in ISSUE]
            for doc, unit, source, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name in categories:
                    a, b = EXTRACTORS[name](source), EXTRACTORS[name](target)
                    if not agree(name, a, b, source, target):
                        for column, value in zip(found, (doc, unit, name, sorted(a), sorted(b)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, ISSUE, strict=True)], schema=ISSUE)

    return clean.mapInArrow(check, "doc_id string, unit_id string, category string, source_markers array<string>, target_markers array<string>")


def issue_hashes(issues: DataFrame) -> DataFrame:
    """``issues`` with ``issue_hash``, which binds a waiver to exactly this finding."""
    body = F.to_json(F.struct("category", "source_markers", "target_markers", "unit_id"), {"ignoreNullFields": "false"})
    return issues.withColumn("issue_hash", F.sha2(body, 256))


def unresolved(issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Issues (with issue_hash) that no resolution of their document names."""
    return issues.join(resolutions.select("doc_id", "issue_hash").distinct(), ["doc_id", "issue_hash"], "left_anti")


def span_problems(translation: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, unit_id, position, problem of spans that do not cover source and target in order without gaps.

    Problems: 'range' (empty or beyond the text), 'order' (does not follow on from the span before), 'end' (the last span
    stops short). Units without any span give 'none', those without a unit or a text no row.
    """
    texts = units.select("doc_id", F.col("id").alias("unit_id"), F.length("source_text").cast("long").alias("source_size"))
    own = translation.select("doc_id", "unit_id", F.length("chinese_text").cast("long").alias("target_size"), "spans").join(texts, ["doc_id", "unit_id"]).where("target_size is not null and source_size is not null")
    each = own.select("doc_id", "unit_id", "source_size", "target_size", F.size("spans").alias("n"), F.posexplode_outer("spans").alias("position", "s"))
    window = Window.partitionBy("doc_id", "unit_id").orderBy("position")
    a, b, c, d = (F.col(f"s.{x}") for x in ("source_start", "source_end", "target_start", "target_end"))
    wide = each.select("doc_id", "unit_id", "position", "n", "source_size", "target_size", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    before_b, before_d = F.coalesce(F.lag("b").over(window), F.lit(0)), F.coalesce(F.lag("d").over(window), F.lit(0))
    good = (F.col("a") < F.col("b")) & (F.col("c") < F.col("d")) & (F.col("b") <= F.col("source_size")) & (F.col("d") <= F.col("target_size")) & (F.col("a") >= 0) & (F.col("c") >= 0)
    follows = (F.col("a") == before_b) & (F.col("c") == before_d)
    last = (F.col("position") < F.col("n") - 1) | ((F.col("b") == F.col("source_size")) & (F.col("d") == F.col("target_size")))
    problem = F.when(F.col("position").isNull(), "none").when(~good, "range").when(~follows, "order").when(~last, "end")
    return wide.withColumn("problem", problem).where("problem is not null").select("doc_id", "unit_id", F.col("position").cast("long").alias("position"), "problem")


def term_problems(translation: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, unit_id, position of terms whose quotes do not stand where their offsets say."""
    texts = units.select("doc_id", F.col("id").alias("unit_id"), "source_text")
    each = translation.select("doc_id", "unit_id", "chinese_text", F.posexplode("terminology").alias("position", "t")).join(texts, ["doc_id", "unit_id"])
    quote = lambda text, a, b: F.col(text).substr(F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int"))
    same = (quote("source_text", "t.source_start", "t.source_end") == F.col("t.source")) & (quote("chinese_text", "t.target_start", "t.target_end") == F.col("t.target"))
    return each.where(~F.coalesce(same, F.lit(False))).select("doc_id", "unit_id", F.col("position").cast("long").alias("position"))


def first_terms(translation: DataFrame, order: DataFrame) -> DataFrame:
    """doc_id, source, target, unit_id, source_start of the first occurrence of each term in a document's reading order;
    ``order``: doc_id, unit_id, unit_order. Terms that differ in case alone are one."""
    each = translation.select("doc_id", "unit_id", F.explode("terminology").alias("t")).join(order, ["doc_id", "unit_id"])
    item = F.struct("unit_order", F.col("t.source_start").alias("source_start"), "unit_id", F.col("t.source").alias("source"), F.col("t.target").alias("target"))
    best = each.groupBy("doc_id", F.lower("t.source").alias("term")).agg(F.min(item).alias("m"))
    return best.select("doc_id", "term", "m.source", "m.target", "m.unit_id", "m.source_start")


def ambiguity_key(frame: DataFrame, meanings: str, *facts: str) -> DataFrame:
    """``frame`` with ``ambiguity_key``: a hash of the facts and the meanings in any order; null unless there are two
    meanings at least and every fact is a valid one-line text."""
    short = [compact(F.col(c), 240, fold=True) for c in facts]
    own = F.array_sort(F.array_distinct(F.transform(meanings, lambda m: F.lower(F.trim(m)))))
    named = frame.withColumns({f"fact{k}_": c for k, c in enumerate(short)}).withColumn("meanings_", own)
    body = F.to_json(F.struct(*[f"fact{k}_" for k in range(len(short))], "meanings_"))
    sound = F.size("meanings_") >= 2
    for k in range(len(short)):
        sound = sound & F.col(f"fact{k}_").isNotNull()
    return named.withColumn("ambiguity_key", F.when(sound, F.sha2(body, 256))).drop(*[f"fact{k}_" for k in range(len(short))], "meanings_")


def review_gate(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, passed, hard_errors of each review: it passes if no issue of severity hard_error is left unresolved.

    ``issues``: doc_id, severity, resolved. A null ``resolved`` counts as not resolved.
    """
    hard = issues.where((F.col("severity") == "hard_error") & ~F.coalesce("resolved", F.lit(False))).groupBy("doc_id").agg(F.count("*").alias("hard_errors"))
    joined = reviews.select("doc_id").distinct().join(hard, "doc_id", "left").withColumn("hard_errors", F.coalesce("hard_errors", F.lit(0)).cast("long"))
    return joined.select("doc_id", (F.col("hard_errors") == 0).alias("passed"), "hard_errors")
