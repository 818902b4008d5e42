"""Sources and sinks beyond tables: page objects by a pluggable parser, bounded files, strict JSON, canonical artefacts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quirespark.functions.text import nfc

CHARACTER = "doc_id string, page_number int, id string, text string, x0 long, y0 long, x1 long, y1 long, font_name string, font_size_mpt long"
#: Parsers by name: each gives the character rows of pages first..last of one file. No PDF library is required here.
PARSERS: dict[str, Callable[[str, int, int], Iterator[tuple]]] = {}
#: What counts the pages of a file for a parser of the same name.
PAGE_COUNTS: dict[str, Callable[[str], int]] = {}


def records_parser(path: str, first: int, last: int) -> Iterator[tuple]:
    """Rows of a JSON-lines file of characters, one object a line with the fields of ``CHARACTER``."""
    names = [c.split()[0] for c in CHARACTER.split(", ")]
    with open(path, encoding="utf-8") as file:
        for line in file:
            if line.strip():
                row = json.loads(line)
                if first <= row["page_number"] <= last:
                    yield tuple(row.get(n) for n in names)


def records_pages(path: str) -> int:
    with open(path, encoding="utf-8") as file:
        return max((json.loads(line)["page_number"] for line in file if line.strip()), default=0)


PARSERS["records"], PAGE_COUNTS["records"] = records_parser, records_pages


class Pages(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class PageObjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"])
        name = options.get("parser", "records")
        self.parser, self.count = PARSERS[name], PAGE_COUNTS[name]
        self.most, self.step = int(options.get("pages", "0")), int(options.get("pagesPerTask", "50"))

    def partitions(self) -> list[Pages]:
        """Ranges of the pages that each file has; a file with more than the option ``pages`` allows is an error."""
        found = []
        for path in self.paths:
            n = self.count(path)
            if self.most and n > self.most:
                raise ValueError(f"{path} has {n} pages, more than {self.most}")
            found += [Pages(path, a, min(a + self.step - 1, n)) for a in range(1, n + 1, self.step)]
        return found

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from self.parser(partition.path, partition.first, partition.last)


class PageObjects(DataSource):
    """``spark.read.format("page_objects").option("paths", json list).option("parser", name)``: one task a range of pages."""

    @classmethod
    def name(cls) -> str:
        return "page_objects"

    def schema(self) -> str:
        return CHARACTER

    def reader(self, schema) -> PageObjectReader:  # noqa: ARG002
        return PageObjectReader(self.options)


def bounded_files(spark: SparkSession, path: str, maximum: int = 100 * 2**20) -> DataFrame:
    """path, size, sha256 of the files of at most ``maximum`` bytes; larger ones are left out before they are hashed."""
    found = spark.read.format("binaryFile").load(path).where(F.col("length") <= maximum)
    return found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def strict_json(frame: DataFrame, text: str, schema: str) -> DataFrame:
    """``frame`` with ``value`` by a fixed schema and ``bad``: texts that are no such object, are no JSON at all, hold NaN or
    Infinity, or name a key twice. Null is bad."""
    plain = F.from_json(text, schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "corrupt_"})

    return frame.withColumn("value", plain).withColumn("bad", F.col(text).isNull() | _no_object(F.col(text)))


def _once(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError
    return dict(pairs)


def _refuse(name: str) -> None:
    raise ValueError(name)


def _no_object(column: Column) -> Column:
    """Texts that are no JSON object, hold NaN or Infinity, or name a key twice; each different text of a batch once."""

    def bad(t: str | None) -> bool:
        try:
            return not isinstance(json.loads(t or "", object_pairs_hook=_once, parse_constant=_refuse), dict)
        except ValueError:
            return True

    @F.pandas_udf("boolean")
    def judge(texts: pd.Series) -> pd.Series:
        known = {t: bad(t) for t in texts.unique()}
        return texts.map(lambda t: known.get(t, True))

    return judge(column)


def canonical(*fields: str) -> Column:
    """One JSON text of the fields: names in order, no blanks, nulls kept."""
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def canonical_hash(*fields: str) -> Column:
    return F.sha2(canonical(*fields), 256)


def normal_strings(frame: DataFrame) -> DataFrame:
    """``frame`` with every text column in Unicode normal form C, as artefacts keep them."""
    return frame.select(*[nfc(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in frame.dtypes])


def write_once(frame: DataFrame, path: str) -> str:
    """Writes a new Parquet folder, reads it back and gives a hash of its rows in any order; an existing one is an error."""
    frame.write.mode("errorifexists").parquet(path)
    return content_hash(frame.sparkSession.read.parquet(path))


def content_hash(frame: DataFrame) -> str:
    """A hash of all rows, whatever their order and files: their count and the sums of two hashes of each."""
    row = F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"})
    n, a, b = frame.agg(F.count("*"), *[F.sum(F.xxhash64(row, F.lit(k)).cast("decimal(38,0)")) for k in (0, 1)]).first()
    return f"{n}:{a or 0}:{b or 0}"


def write_or_verify(frame: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Adds rows whose keys are new and gives those whose keys are there with other values, which are not written."""
    spark = frame.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        frame.write.parquet(path)
        return frame.limit(0)
    there = spark.read.parquet(path).select(*keys, canonical_hash(*frame.columns).alias("there_"))
    judged = frame.withColumn("own_", canonical_hash(*frame.columns)).join(there, keys, "left")
    conflict = judged.where("there_ is not null and there_ <> own_").drop("own_", "there_")
    judged.where("there_ is null").drop("own_", "there_").write.mode("append").parquet(path)
    return conflict


def export_sorted(frame: DataFrame, path: str, order: list[str]) -> None:
    """All rows in order as JSON lines; an existing export is an error."""
    frame.orderBy(*order).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
