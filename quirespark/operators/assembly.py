"""Putting parts together and freezing them: drafts, sets with one hash, limits, insertions, box and count checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.geometry import contains
from quirespark.functions.text import nth_position
from quirespark.operators.layout import grapheme_clusters


def count_bounds(observed: DataFrame, expected: DataFrame, keys: list[str], slack: int = 20, low: int = 90, high: int = 110) -> DataFrame:
    """keys, observed, expected, good: whether a count lies within ``low`` to ``high`` per cent and within ``slack`` of what is
    expected. A key that one side lacks counts 0 there."""
    joined = observed.select(*keys, "observed").join(expected.select(*keys, "expected"), keys, "full_outer").select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("observed", "expected")])
    good = (F.col("observed") * 100 >= F.col("expected") * low) & (F.col("observed") * 100 <= F.col("expected") * high) & (F.abs(F.col("observed") - F.col("expected")) <= slack)
    return joined.withColumn("good", good)


def frozen(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, n, set_hash: a hash of a key's rows whatever their order and repetition."""
    row = F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
    own = rows.select(key, row.alias("h_")).distinct()
    return own.groupBy(key).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h_")), ""), 256).alias("set_hash"))


def repeated_candidates(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, value, n of values (in lower case) that more than one candidate of a key has where each must be unique."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias("value")) for f in fields]))
    each = rows.select(key, pairs.alias("p")).select(key, "p.field", "p.value").where("value is not null")
    return each.groupBy(key, "field", "value").agg(F.count("*").alias("n")).where("n > 1")


def over_limits(rows: DataFrame, keys: list[str], limits: dict[str, tuple[Column, int]]) -> DataFrame:
    """keys, limit, observed, maximum of the sums that exceed their maximum."""
    summed = rows.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(n) for n, (c, _) in limits.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("limit"), F.col(n).alias("observed"), F.lit(m).cast("long").alias("maximum")) for n, (_, m) in limits.items()]))
    return summed.select(*keys, each.alias("l")).select(*keys, "l.limit", "l.observed", "l.maximum").where("observed > maximum")


def assembled(units: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The units with their drafts, and the problems that keep a draft out.

    ``units``: doc_id, unit_id, source_text; ``drafts``: doc_id, unit_id, target_text, quote, occurrence. The first table has
    quote_start (0-based, null without a quote); problems are 'missing', 'unknown', 'repeated' and 'quote' (not found).
    """
    keys = ["doc_id", "unit_id"]
    counts = drafts.groupBy(*keys).agg(F.count("*").alias("n"))
    both = units.join(counts, keys, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("source_text").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    single = drafts.join(counts.where("n = 1").select(*keys), keys).join(units.where("source_text is not null"), keys)
    placed = single.withColumn("quote_start", nth_position(F.col("source_text"), F.col("quote"), F.coalesce("occurrence", F.lit(0))))
    lost = placed.where("quote is not null and quote_start is null").select(*keys, F.lit("quote").alias("problem"))
    problems = both.withColumn("problem", problem).where("problem is not null").select(*keys, "problem").unionByName(lost)
    return placed.where("quote is null or quote_start is not null"), problems


def inserted(frame: DataFrame, text: str, insertions: str) -> DataFrame:
    """``frame`` with ``composite``: the text with insertions (array of struct<at: long, label: string>) spliced in at their
    0-based offsets, those at one place in order of their labels. Offsets beyond the text go to its end."""
    size = F.length(text)
    marks = F.array_sort(F.transform(insertions, lambda i: F.struct(F.least(i["at"].cast("long"), size.cast("long")).alias("at"), i["label"].alias("label"))))
    start = F.struct(F.lit(0).cast("long").alias("done"), F.lit("").alias("out"))
    folded = F.aggregate(marks, start, lambda s, i: F.struct(i["at"].alias("done"), F.concat(s["out"], F.col(text).substr((s["done"] + 1).cast("int"), (i["at"] - s["done"]).cast("int")), i["label"]).alias("out")))
    return frame.withColumn("f_", folded).withColumn("composite", F.concat(F.col("f_.out"), F.col(text).substr((F.col("f_.done") + 1).cast("int"), size))).drop("f_")


def split_graphemes(spans: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """The spans of which an end lies inside a cluster that must stay whole."""
    parts = grapheme_clusters(F.col(text))
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda out, c: F.concat(out, F.array(F.element_at(out, -1) + F.length(c))))
    edged = spans.withColumn("edges_", ends)
    return edged.where(~(F.array_contains("edges_", F.col(start).cast("int")) & F.array_contains("edges_", F.col(end).cast("int")))).drop("edges_")


def page_box_problems(pages: DataFrame) -> DataFrame:
    """``pages`` (media and crop boxes m_x0 .., c_x0 .., rotation) with ``problem``: 'empty', 'outside' or 'rotation'."""
    m, c = (tuple(F.col(f"{p}_{k}") for k in ("x0", "y0", "x1", "y1")) for p in ("m", "c"))
    positive = (m[0] < m[2]) & (m[1] < m[3]) & (c[0] < c[2]) & (c[1] < c[3])
    problem = F.when(~F.coalesce(positive, F.lit(False)), "empty").when(~contains(m, c), "outside").when(F.coalesce(F.col("rotation"), F.lit(0)) % 90 != 0, "rotation")
    return pages.withColumn("problem", problem).where("problem is not null")


def aligned_tails(planned: DataFrame, drawn: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, from_end, planned, drawn where two sequences differ when they are laid together from their ends."""
    def back(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(key, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))).cast("long").alias("from_end"), F.col(value).alias(name))

    both = back(planned, "planned").join(back(drawn, "drawn"), [key, "from_end"], "left")
    return both.where(~F.col("planned").eqNullSafe(F.col("drawn")))
