"""Reading delimited text, ARFF and record-like XML as Spark tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# fixed values: separators considered, in order of preference
SEPARATORS = [",", ";", "\t", "|"]
SNIFFED_CHARS, SNIFFED_LINES = 8192, 200


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Separator that splits the first lines into the same number (at least two) of fields, the most fields first."""
    lines = [r["value"] for r in spark.read.text(path).limit(SNIFFED_LINES).collect()]
    sample, size = [], 0
    for line in lines:
        if not line.strip() or size + len(line) > SNIFFED_CHARS:
            continue
        sample.append(line)
        size += len(line)
    best, fields = ",", 1
    for sep in SEPARATORS:
        counts = {line.count(sep) for line in sample}
        if len(counts) == 1 and counts != {0} and counts.copy().pop() + 1 > fields:
            best, fields = sep, counts.pop() + 1
    return best


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None, separator: str | None = None) -> tuple[DataFrame, dict]:
    """Typed table (given schema, or one inference pass) with its separator."""
    sep = separator or detect_delimiter(spark, path)
    reader = spark.read.option("sep", sep).option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df, {"separator": sep, "columns": len(df.columns)}


def read_text_columns(spark: SparkSession, path: str, separator: str | None = None) -> tuple[DataFrame, list[str]]:
    """Every column as text ("007" stays "007"), with the repeated header names."""
    sep = separator or detect_delimiter(spark, path)
    header = [h.strip() for h in spark.read.option("sep", sep).csv(path).limit(1).first()]
    repeated = sorted({h for h in header if header.count(h) > 1})
    shape = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    names = [h if header[:i].count(h) == 0 else f"{h}__{header[:i].count(h) + 1}" for i, h in enumerate(header)]
    df = spark.read.option("sep", sep).option("header", True).option("enforceSchema", True).option("nullValue", "\u0000").option("emptyValue", "").schema(shape).csv(path)
    return df.toDF(*names), repeated


def arff_header(spark: SparkSession, path: str) -> dict:
    """Relation, attributes in file order with their declaration, and the declared target.

    Only header lines are collected; their order is the byte offset of the split plus the position inside it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    head = lines.filter(F.ltrim("value").rlike(r"^(@|%)")).withColumn("text", F.trim("value"))
    attr = r"(?i)^@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)$"
    found = head.select("file", "block", "pos", "text", F.regexp_extract("text", attr, 1).alias("name"), F.regexp_extract("text", attr, 2).alias("kind"), F.regexp_extract("text", r"(?i)target\s*=\s*(\S+)", 1).alias("target"),
                        F.regexp_extract("text", r"(?i)^@relation\s+(.*)$", 1).alias("relation"), F.regexp_extract("text", r"-C\s+(-?\d+)", 1).alias("class_at")).orderBy("file", "block", "pos").collect()
    attributes = [(r["name"].strip("'\""), r["kind"].strip()) for r in found if r["name"]]
    names = [a for a, _ in attributes]
    target = next((r["target"].strip("'\"") for r in found if r["text"].startswith("%") and r["target"]), None)
    relation = next((r["relation"].strip("'\"") for r in found if r["relation"]), None)
    at = next((int(r["class_at"]) for r in found if r["relation"] and r["class_at"]), 0)
    if target is None and at and abs(at) <= len(names):
        target = names[at] if at < 0 else names[at - 1]
    return {"relation": relation, "attributes": attributes, "target": target if target in names else None}


def declared_kind(declaration: str) -> tuple[str, list[str]]:
    """Kind and ordered nominal values of an attribute declaration."""
    text = declaration.strip()
    if text.startswith("{"):
        return "nominal", [v.strip().strip("'\"") for v in text.strip("{}").split(",")]
    low = text.lower()
    return ("numeric" if low.startswith(("numeric", "real", "integer")) else "date" if low.startswith("date") else "text"), []


def read_arff(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Data rows parsed with the schema the header declares; ? and empty become NULL; nominal values stay text."""
    meta = arff_header(spark, path)
    shape = T.StructType([T.StructField(n, T.DoubleType() if declared_kind(d)[0] == "numeric" else T.StringType()) for n, d in meta["attributes"]])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields)
    data = spark.read.text(path).filter((F.trim("value") != "") & ~F.ltrim("value").rlike("^(@|%)"))
    parsed = data.select(F.from_csv("value", ddl, {"nullValue": "?", "quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    return parsed.select("r.*"), meta


def read_records(spark: SparkSession, path: str, row_tag: str, fields: Sequence[str], id_pattern: str, type_tag: str) -> DataFrame:
    """Record-like XML blocks as rows: literal and resource children become columns, the type becomes the label."""
    resource = T.StructType([T.StructField("_rdf:resource", T.StringType()), T.StructField("_VALUE", T.StringType())])
    shape = T.StructType([T.StructField("_rdf:about", T.StringType()), *[T.StructField(f, resource) for f in fields], T.StructField(type_tag, resource)])
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(shape).load(path)
    last = lambda c: F.regexp_extract(c, "([^#/]*)$", 1)
    value = lambda f: F.coalesce(F.col(f"`{f}`.`_VALUE`"), last(F.col(f"`{f}`.`_rdf:resource`"))).alias(f)
    return raw.select(F.regexp_extract("`_rdf:about`", id_pattern, 1).cast("long").alias("row"), *[value(f) for f in fields], last(F.col(f"`{type_tag}`.`_rdf:resource`")).alias("label")).filter("row IS NOT NULL")


def enclosed(lines: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """Text lines with a first (and last) line around every partition, so each written file stands on its own."""

    def wrap(batches):
        yield pd.DataFrame({"value": [first]})
        yield from batches
        if last is not None:
            yield pd.DataFrame({"value": [last]})

    return lines.select("value").mapInPandas(wrap, "value string")
