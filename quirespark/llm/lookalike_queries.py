"""Problem 1 over DataFrames: normal forms of every text, and pairs of records that only look equal."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.lookalike import normal_forms
from quirespark.llm.records import by_batch, slices, two_hashes
from quirespark.sources.tables import cut, table

#: Bytes of text whose code points are arrays at a time.
PART = 1_000_000
GROUP = ["g1", "g2"]


def with_normal_form(frame: DataFrame, text: str = "text", out: str = "normal_text") -> DataFrame:
    """``frame`` with column ``out``, the normal form of column ``text``.

    Null stays null, an empty text stays empty; an existing column ``out`` is replaced. Other columns pass unchanged.
    """
    kept = frame.drop(out)
    schema = kept.withColumn(out, F.lit(None).cast("string")).schema

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = batch.schema.get_field_index(text)
        for part in slices(batch, own, PART):
            yield pa.RecordBatch.from_arrays([*part.columns, normal_forms(part.column(own))], names=[*part.schema.names, out])

    return by_batch(kept, work, schema)


def _members(records: DataFrame) -> DataFrame:
    """kind, key, g1, g2, t1, t2 of the records whose group (kind, place, normal form) holds more than one text."""
    known = with_normal_form(records.where("text is not null"), out="shape")
    shapes = known.select("kind", "key", F.col("shape").rlike(r"\S"), *[c.alias(n) for c, n in zip([*two_hashes("kind", "place", "shape"), *two_hashes("text")], ("g1", "g2", "t1", "t2"), strict=True)]).toDF("kind", "key", "seen", "g1", "g2", "t1", "t2")
    shapes = cut(shapes.where("seen or kind <> 'document'").drop("seen"))
    mixed = shapes.groupBy(*GROUP).agg(F.min("t1").alias("least"), F.max("t1").alias("most")).where("least <> most").select(*GROUP)
    return cut(shapes.join(mixed, GROUP, "left_semi").distinct())


def lookalike_classes(records: DataFrame) -> DataFrame:
    """kind, key, class_id, links of each record that looks like one with another text: how many records it is paired with.

    One row a record, however large its class; the counts are aggregates that combine before the shuffle. Null texts and
    repeated rows give nothing more.
    """
    members = _members(records)
    sizes = members.groupBy(*GROUP, "t1", "t2").agg(F.count("*").alias("same"))
    whole = sizes.groupBy(*GROUP).agg(F.sum("same").alias("all"))
    links = sizes.join(whole, GROUP).select(*GROUP, "t1", "t2", (F.col("all") - F.col("same")).cast("long").alias("links"))
    return members.join(links, [*GROUP, "t1", "t2"]).select("kind", "key", F.concat_ws("-", F.hex("g1"), F.hex("g2")).alias("class_id"), "links")


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """kind, key_a, key_b of each two records (kind, place, key, text) of one place whose texts look alike but differ.

    ``place`` is what both must share. Null texts and repeated rows give nothing more. Records are grouped by 128 bits of
    (kind, place, normal form). Groups of one text alone, however large, end in the first aggregate, which combines
    before the shuffle; within the others only pairs of different texts are joined and then widened to their records,
    so the work follows the result.
    """
    group, members = GROUP, _members(records)
    texts = members.select(*group, "t1", "t2").distinct()
    other = texts.select(*group, F.col("t1").alias("o1"), F.col("t2").alias("o2"))
    pairs = texts.join(other, group).where("t1 < o1 or (t1 = o1 and t2 < o2)")
    left = members.select("kind", *group, "t1", "t2", F.col("key").alias("key_l"))
    right = members.select(*group, F.col("t1").alias("o1"), F.col("t2").alias("o2"), F.col("key").alias("key_r"))
    found = pairs.join(left, [*group, "t1", "t2"]).join(right, [*group, "o1", "o2"]).where("key_l <> key_r")
    return found.select("kind", F.least("key_l", "key_r").alias("key_a"), F.greatest("key_l", "key_r").alias("key_b")).distinct()


def overprinted(chars: DataFrame) -> DataFrame:
    """The rows of page_char that share their box with another id and a character beyond ASCII.

    Two texts of plain ASCII that look alike are equal, so a group without any other character holds no case.
    """
    box = ["doc_id", "page_number", "x0", "y0", "x1", "y1"]
    rows = chars.select(*box, "id", "text")
    keyed = rows.withColumn("box", F.xxhash64(*box))
    odd = F.max(F.col("text").rlike(r"[^\x21-\x7e]"))
    groups = keyed.groupBy("box").agg(F.min(F.xxhash64("id")).alias("least"), F.max(F.xxhash64("id")).alias("most"), odd.alias("odd"))
    hot = groups.where("odd and least <> most").select("box")
    return keyed.join(hot, "box", "left_semi").drop("box")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.lit("document").alias("kind"), F.lit("").alias("place"), F.col("doc_id").cast("string").alias("key"), "text")
    own = F.concat_ws("/", "doc_id", "id").alias("key")
    lines = table(spark, folder, "text_line").select(F.lit("line").alias("kind"), F.col("doc_id").alias("place"), own, "text")
    box = F.concat_ws("/", "doc_id", "page_number", "x0", "y0", "x1", "y1").alias("place")
    chars = overprinted(table(spark, folder, "page_char")).select(F.lit("char").alias("kind"), box, own, "text")
    return docs.unionByName(lines).unionByName(chars)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(_records(spark, folder))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of p1_found once, with its class and how many pairs it is in."""
    return lookalike_classes(_records(spark, folder))


def p1_normal_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, normal_text of every document."""
    return with_normal_form(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def p1_normal_lines(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, id, normal_text of every text line, deliveries once."""
    return with_normal_form(table(spark, folder, "text_line").select("doc_id", "id", "text").distinct()).drop("text")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_normal_documents": p1_normal_documents, "p1_normal_lines": p1_normal_lines}
SQL: dict[str, str] = {}
