"""Folders of documents, predictions and benchmark cases as DataFrames, and result sinks."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.payload import strict_json
from quarry.functions.text import let


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir or the context's checkpoint folder; a temporary one where executors are threads of the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return f"{root.rstrip('/')}/quarry-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, ext, text) of files, bad UTF-8 bytes left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    @F.arrow_udf("string")
    def decoded(content: pa.Array) -> pa.Array:
        return pa.array([x.as_py().decode("utf-8", "ignore") for x in content], pa.string())

    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), decoded("content").alias("text"))


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, payload) of JSON files, one row each."""
    whole = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    file = F.col("_metadata.file_path")
    return whole.select(file.alias("path"), F.regexp_extract(file, r"([^/]+)\.json$", 1).alias("name"), F.col("value").alias("payload"))


def read_evaluation(spark: SparkSession, path: str, engines: list[str] | None = None) -> DataFrame:
    """(engine, name, predicted, gold, schema) of predictions/<engine>/*.json beside gold/*.json; the schema is optional."""
    predicted = read_json_files(spark, f"{path}/predictions").select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("engine"), "name", F.col("payload").alias("predicted"))
    if engines:
        predicted = predicted.where(F.col("engine").isin(engines))
    gold = read_json_files(spark, f"{path}/gold")
    schemas = gold.where(F.col("name").endswith(".schema")).select(F.regexp_replace("name", r"\.schema$", "").alias("name"), F.col("payload").alias("schema"))
    return predicted.join(gold.where(~F.col("name").endswith(".schema")).select("name", F.col("payload").alias("gold")), "name").join(schemas, "name", "left")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(name, document, text, schema, gold) of a benchmark folder: stem.schema.json, stem.gold.json, and the first other file of the stem."""
    files = read_json_files(spark, path)
    part = lambda kind: files.where(F.col("name").endswith(f".{kind}")).select(F.regexp_replace("name", rf"\.{kind}$", "").alias("name"), F.col("payload").alias(kind))
    docs = read_documents(spark, path).where(~F.col("path").rlike(r"\.(schema|gold)\.json$")).withColumn("name", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    first = docs.groupBy("name").agg(F.min_by(F.struct("path", "text"), "path").alias("d")).select("name", F.col("d.path").alias("document"), "d.text")
    return part("schema").join(part("gold"), "name").join(first, "name")


def members(payload: Column | str) -> Column:
    """map<string, variant> of the members of a JSON object's text; null for what is none."""
    return F.try_parse_json(payload).try_cast("map<string,variant>")


def json_fields(df: DataFrame, payload: str, keys: list[str], as_json: bool = False) -> DataFrame:
    """(*keys, field, value) of the members of a JSON object column, strings without quotes unless as_json; JSON null is null."""
    at = df.select(*keys, F.explode(members(payload)).alias("field", "v"))
    value = F.to_json("v") if as_json else F.try_variant_get("v", F.lit("$"), "string")
    return at.select(*keys, "field", value.alias("value"))


def require_object(text: str) -> Column:
    """A JSON text that must be an object: an error for any other."""

    def checked(t: Column) -> Column:
        found = F.when(t.startswith("{") & t.endswith("}"), strict_json(t))
        return F.coalesce(found, F.when(t.isNotNull(), F.raise_error(F.concat(F.lit("Expected a JSON object: "), F.left(F.col(text), F.lit(80))))))

    return let(F.trim(text), checked)


def write_results(df: DataFrame, path: str, form: str = "json") -> None:
    """Results as JSON lines, Parquet or any format Spark writes."""
    df.write.format(form).save(path)
