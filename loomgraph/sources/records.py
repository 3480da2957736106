"""Readers of record files. Every reader gives a 1-based `seq`, the order that "first" refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.scratch import Tables

ENTITY = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
TRIPLE = T.StructType(
    [
        T.StructField("source_pmid", T.StringType()),
        T.StructField("entity_1", ENTITY),
        T.StructField("relation", T.StringType()),
        T.StructField("entity_2", ENTITY),
        T.StructField("evidence_text", T.StringType()),
        T.StructField("evidence_sentence", T.StringType()),
        T.StructField("evidence", T.StructType([T.StructField("text", T.StringType())])),
        T.StructField("assertion_context", T.MapType(T.StringType(), T.StringType())),
        *[T.StructField(c, T.StringType()) for c in ("llm_confidence", "confidence", "self_confidence", "confidence_score")],
        T.StructField("extracted_by", T.StringType()),
        T.StructField("computed_confidence", T.DoubleType()),
    ]
)
ABSTRACT = T.StructType([T.StructField(n, T.StringType()) for n in ("pmid", "title", "abstract", "pub_date")])
ASSOCIATION = T.StructType([T.StructField(n, T.StringType()) for n in ("disease_id", "gene_symbol", "target_id")] + [T.StructField("score", T.DoubleType())])


def _number(rows: DataFrame, blocks: list[str]) -> DataFrame:
    """Written rows with (blocks, __at) as rows with seq: blocks in order, in each by __at, whose steps there are one."""
    sizes = rows.groupBy(*blocks).agg(F.count(F.lit(1)).alias("__size"), F.min("__at").alias("__first"))
    # One row for each block (a partition or a stretch of a file), so a window over all of them is small.
    before = Window.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*blocks, (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first") + 1).alias("__offset"))
    return rows.join(F.broadcast(offsets), blocks).withColumn("seq", F.col("__offset") + F.col("__at")).drop(*blocks, "__at", "__offset")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with seq, the 1-based rank in the given total order; rows that tie in it are ranked as they come.

    Rows are dealt to ranges of the order, sorted and given their place in their range in one
    stage, whose result is written: sizes of ranges and places are thus of the same ranges. A
    column named seq is replaced.
    """
    if not order:
        raise ValueError("a total order is needed")
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition's number, then the place in it
    placed = ranged.withColumns({"__part": F.shiftrightunsigned(place, 33), "__at": place.bitwiseAND(F.lit((1 << 33) - 1))})
    return _number(Tables(df.sparkSession, "numbered").write(placed, "placed"), ["__part"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line): the lines of text files, numbered from 1 in the order of files' paths. Blank lines count but are left out.

    A task reads a stretch of a file from its start to its end, so lines are known by file,
    stretch and place in it. They are written with these once, as another read might cut the
    files elsewhere.
    """
    source = spark.read.text(path).select(F.col("value").alias("line"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("__at"))
    placed = Tables(spark, "lines").write(source, "placed")
    return _number(placed, ["file_path", "file_block_start"]).select("seq", "line").where(F.trim("line") != "")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict scan: a malformed record fails the query that reads it."""
    return read_lines(spark, path).select("seq", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("record")).select("seq", "record.*")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType, objects_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, errors): errors are (line, error, raw), raw cut after 500 characters.

    objects_only: valid JSON that is no object is an error as well.
    """
    parsed = read_lines(spark, path).withColumn("__value", F.try_parse_json("line"))
    shape = F.schema_of_variant("__value")
    error = F.when(F.col("__value").isNull(), "invalid_json")
    if objects_only:
        error = error.when(~shape.startswith("OBJECT"), "not_an_object")
    parsed = parsed.withColumn("__error", error)
    errors = parsed.where("__error IS NOT NULL").select(F.col("seq").alias("line"), F.col("__error").alias("error"), F.substring("line", 1, 500).alias("raw"))
    records = parsed.where("__error IS NULL").select("seq", F.from_json("line", schema).alias("record")).select("seq", "record.*")
    return records, errors


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV file, a byte order mark at its start ignored."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_settings(path: str, known: dict[str, str] | None = None) -> dict[str, str]:
    """key=value lines of a settings file, quotes around values and comments left out; what is known already stays."""
    out = dict(known or {})
    with open(path, encoding="utf-8") as lines:
        for line in map(str.strip, lines):
            key, sign, value = line.partition("=")
            if sign and not line.startswith("#"):
                out.setdefault(key.strip(), value.strip().strip("\"'"))
    return out


def slice_rows(df: DataFrame, offset: int, limit: int = -1) -> DataFrame:
    """Rows offset + 1 to offset + limit by seq; all from offset on for a negative limit."""
    picked = df.where(F.col("seq") > offset)
    return picked.where(F.col("seq") <= offset + limit) if limit >= 0 else picked


def abstracts_by_id(df: DataFrame) -> DataFrame:
    """(pmid, title, abstract), the last record of each id; blank ids left out."""
    known = df.where(F.trim(F.coalesce("pmid", F.lit(""))) != "")
    last = known.groupBy("pmid").agg(F.max_by(F.struct("title", "abstract"), "seq").alias("x"))
    return last.select("pmid", F.coalesce("x.title", F.lit("")).alias("title"), F.coalesce("x.abstract", F.lit("")).alias("abstract"))


def with_text(df: DataFrame, column: str = "abstract") -> DataFrame:
    """Rows whose text isn't blank."""
    return df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "")


def parse_medline(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Records of MEDLINE text, one raw export per row, in which a blank line ends a record.

    Fields are four-character tags with continuation lines of six spaces. Records without an
    abstract are left out.
    """
    unfolded = F.regexp_replace(F.regexp_replace(F.col(raw), "\r\n?", "\n"), r"\n {6}", " ")
    record = df.select(F.posexplode(F.split(unfolded, r"\n\s*\n")).alias("at", "record"))

    def tag(name: str):
        return F.trim(F.regexp_extract("record", rf"(?m)^{name.ljust(4)}- (.*)$", 1))

    fields = record.select("at", tag("PMID").alias("pmid"), tag("TI").alias("title"), tag("AB").alias("abstract"), tag("DP").alias("pub_date"))
    return fields.where("abstract <> ''")
