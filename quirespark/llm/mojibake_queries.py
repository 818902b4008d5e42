"""Problem 4 over DataFrames."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.mojibake import Mender, merge, train
from quirespark.llm.records import by_batch
from quirespark.sources.tables import spread, table

#: Characters that sound texts of the five languages have beyond ASCII; a text with any other is no training text.
SOUND = r"^[\x09-\x7e¡«°±µ»¿ÄÉÖÜß-ïñ-ü–‘-”…、-】一-鿿！-？]*$"
TRAINED = ("en", "zh", "fr", "de", "es")


#: Characters of a sample; longer texts are several. Dictionaries that are merged at a time.
SAMPLE, FAN = 20_000, 32


def dictionaries(documents: DataFrame, each: int = 1000) -> dict[str, bytes]:
    """A dictionary for each language, trained on all its sound texts, each once.

    Texts are dealt by their hash into groups of about ``each``; every group trains a dictionary in a task, and dictionaries
    are merged, ``FAN`` at a time, until one is left of each language, so that every text takes part and no task or driver
    holds many.
    """
    lang = F.lower("lang")
    sound = documents.select(lang.alias("lang"), "text").where(F.col("lang").isin(*TRAINED) & (F.length("text") > 0)).where(~F.col("text").rlike("[ÂÃ][\u0080-¿]") & F.col("text").rlike(SOUND))
    first = F.sequence(F.lit(0), F.call_function("div", F.length("text") - 1, F.lit(SAMPLE).cast("long")).cast("int"))
    samples = sound.select("lang", F.explode(F.transform(first, lambda k: F.substr("text", k * SAMPLE + 1, F.lit(SAMPLE)))).alias("text"))
    groups = {r.lang: -(-r.n // each) for r in samples.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not groups:
        return {}
    count = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])[F.col("lang")]
    grouped = samples.select("lang", F.pmod(F.xxhash64("text"), count).alias("part"), "text").distinct()

    def of_texts(part: pa.Table) -> pa.Table:
        return made(part, train(sorted(x.encode("utf-8", "surrogatepass") for x in part["text"].to_pylist())))

    def of_dictionaries(part: pa.Table) -> pa.Table:
        return made(part, merge(sorted(part["content"].to_pylist())))

    def made(part: pa.Table, content: bytes | None) -> pa.Table:
        kept = part.select(["lang", "part"]).slice(0, int(content is not None))
        return kept.append_column("content", pa.array([content] * kept.num_rows, pa.binary()))

    schema = "lang string, part long, content binary"
    trained = grouped.groupBy("lang", "part").applyInArrow(of_texts, schema)
    most = max(groups.values())
    while most > 1:
        fewer = trained.withColumn("part", F.call_function("div", F.col("part"), F.lit(FAN).cast("long")))
        trained = fewer.groupBy("lang", "part").applyInArrow(of_dictionaries, schema)
        most = -(-most // FAN)
    return {r.lang: bytes(r.content) for r in trained.orderBy("lang").collect()}


@lru_cache(maxsize=2)
def _mender(key: tuple) -> Mender:
    return Mender(dict(key))


def mended(records: DataFrame, models: dict[str, bytes]) -> DataFrame:
    """kind, rec_key, mended_text, chain of each damaged record of ``records`` (kind, rec_key, text).

    ``mended_text`` is null where nothing could be restored (characters lost). Null, empty and plain ASCII texts are
    never damaged; repeated records come out as often as they stand.
    """
    key = tuple(sorted(models.items()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        mender = _mender(key)
        found: list[list] = [[], [], [], []]
        known: dict[str, tuple] = {}
        for kind, rec, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            short = len(text) < 16
            state = known.get(text) if short else None
            if state is None:
                state = mender.damage(text)
                if short:
                    known[text] = state
            if state[0]:
                for out, value in zip(found, (kind, rec, state[1], state[2]), strict=True):
                    out.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in found], names=["kind", "rec_key", "mended_text", "chain"])

    suspect = records.where(F.octet_length("text") > F.length("text")).select("kind", "rec_key", "text")
    # a long text costs far more than its bytes: the few suspects are spread over all tasks by their key
    return by_batch(spread(suspect, "kind", "rec_key"), work, "kind string, rec_key string, mended_text string, chain string")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("rec_key"), "text")
    own = F.concat_ws("/", "doc_id", "id").alias("rec_key")
    lines = table(spark, folder, "text_line").select(F.lit("line").alias("kind"), own, "text")
    chars = table(spark, folder, "page_char").select(F.lit("char").alias("kind"), own, "text")
    return docs.unionByName(lines).unionByName(chars)


def p4_mended(spark: SparkSession, folder: str) -> DataFrame:
    """Every damaged record with its restored text and the chain that restored it."""
    return mended(_records(spark, folder), dictionaries(table(spark, folder, "documents"))).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_mended(spark, folder).select("kind", "rec_key").distinct()


QUERIES = {"p4_found": p4_found, "p4_mended": p4_mended}
SQL: dict[str, str] = {}
