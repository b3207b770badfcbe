"""Sources: JSON lines, JSON arrays, labelled and raw text, delimited files, newest files, and a paged REST source.

Each reader takes a schema where there is one to give, so that no pass is spent on inferring it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EDGE = "struct<from_event:string,to_event:string,relation:string,confidence:double,source:string>"
#: The event graph of a document.
GRAPH = (
    "struct<entities:array<struct<entity_id:string,name:string,kind:string,canonical_role:string,aliases:array<string>>>,"
    "events:array<struct<event_id:string,event_type:string,main_verb:string,participants:array<struct<entity_id:string,role:string>>,time:struct<kind:string,raw_span:string,normalized:string>,"
    "evidence:struct<sentence_ids:array<string>>,confidence:double>>,"
    f"temporal_edges:array<{EDGE}>,causal_edges:array<{EDGE}>>"
)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line; a bad line fails the read, or is left out if not strict. Blank lines are skipped either way."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).filter("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return parsed.filter("r.__bad is null").select("r.*").drop("__bad")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By suffix: .jsonl by lines, else a JSON array; entries that are no objects are left out."""
    if path.endswith(".jsonl"):
        return json_lines(spark, path, schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def json_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All *.json files of a folder, each one record, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def labelled_lines(spark: SparkSession, folder: str, last_tab: bool = True) -> DataFrame:
    """(file, line_no, sentence, label) of text files "sentence<TAB>LABEL"; FAC is 1, all else 0. The tab is the last or the first."""
    text = spark.read.option("wholetext", True).text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    pattern = r"^(.*)\t([^\t]*)$" if last_tab else r"^([^\t]*)\t(.*)$"
    rows = text.filter(F.col("line").rlike(pattern))
    return rows.select("file", "line_no", F.regexp_extract("line", pattern, 1).alias("sentence"), F.when(F.upper(F.trim(F.regexp_extract("line", pattern, 2))) == "FAC", 1).otherwise(0).alias("label"))


def newest_per_folder(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """The newest file of each folder below root that matches; only file names and times are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path", "modificationTime")
    parent = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    newest = files.groupBy(parent.alias("folder")).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
    return sorted(r["path"] for r in newest.collect())  # one path a folder


def sniff_delimiter(line: str) -> str:
    """Of comma, tab, semicolon and bar the one that occurs most; the first of equals."""
    return max(",\t;|", key=lambda c: (line.count(c), -",\t;|".index(c)))


def delimited(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file with a header and quoted fields; the delimiter is told from the first line."""
    first = spark.read.text(path).first()
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sniff_delimiter(first[0] if first else ","))
    return (reader.schema(schema) if schema else reader).csv(path)


def filing_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, source_url, title, body) of raw filings: two header lines, then the text."""
    t = spark.read.option("wholetext", True).text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")
    return t.select("file", F.regexp_extract("value", r"(?m)^Source URL:\s*(.*)$", 1).alias("source_url"), F.regexp_extract("value", r"(?m)^Title:\s*(.*)$", 1).alias("title"), F.regexp_replace("value", r"\A(?:(?:Source URL|Title):[^\n]*\n)*\s*", "").alias("body"))


def limit_chunks(docs: DataFrame, order: str, chunks: str, most_docs: int, most_chunks: int) -> DataFrame:
    """The first documents by order, their chunks cut where the running total passes most_chunks.

    The number of documents is bounded first, so the running total is over most_docs rows.
    """
    some = docs.orderBy(order).limit(most_docs)
    before = F.coalesce(F.sum(F.size(chunks)).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return some.withColumn("__left", F.greatest(F.lit(0), most_chunks - before).cast("int")).withColumn(chunks, F.slice(chunks, F.lit(1), F.col("__left"))).drop("__left")


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.paths, self.field = schema, json.loads(options.get("pages", "[]")), options.get("results", "results")

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in self.paths]

    def read(self, partition: _Page) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            page = json.load(f)
        for row in page.get(self.field, []):
            yield tuple(row.get(c.name) for c in self.schema.fields)


class PagedSource(DataSource):
    """Pages of a REST listing {"results": [..], "next": ..} as saved files, one partition a page.

    spark.dataSource.register(PagedSource); spark.read.format("paged").schema(..).option("pages", json.dumps([..])).load()
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not fetched before."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")
