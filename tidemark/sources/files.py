"""Files in and out. Everything is read by Spark, from any store that it reaches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LINKS, METADATA_FILE, SUPPLEMENTS, posts

RESULT_SUFFIX, METADATA_SUFFIX = ".result.json", ".info.json"
_TEXT_FILE = T.StructType([T.StructField("value", T.StringType())])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` that driver and executors share, below ``spark.checkpoint.dir``.

    In a local session without that setting a temporary folder does; anywhere else
    it has to be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors reach")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """A links table from CSV with header; quoted titles can span lines."""
    return spark.read.schema(LINKS).csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Search terms, one a line; blank lines are skipped."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("term"))


def file_key(suffix: str) -> Column:
    """The name of a row's file without its suffix, percent-encoded as Spark gives it."""
    name = F.col("_metadata.file_name")
    return F.when(name.endswith(suffix), F.substr(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def write_responses(df: DataFrame, folder: str, key: str = "file_key", value: str = "value") -> None:
    """Adds each row's text to ``folder`` as a file of its own, in a subfolder that is named by its key.

    Spark's tasks write them, so keys may hold anything and no row passes the driver;
    names are escaped as Spark does it. Rows of one key share a subfolder, in a file each
    for each task. Rows without key or text have no file.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(value).alias("value"), F.col(key).cast("string").alias("file_key"))
    rows.write.partitionBy("file_key").mode("append").option("lineSep", "\n").text(folder)


def pack_responses(df: DataFrame, folder: str, key: str = "file_key", value: str = "value") -> None:
    """Adds each row's text to ``folder`` with its key, many to a file.

    Files of their own (``write_responses``) cost a folder and a file each to make, and the
    driver lists and holds all of them on reading; packs are as many as the writing tasks,
    however many responses there are. Keys and texts may hold anything and come back as they
    were. Rows without key or text are left out.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(value).alias("value"), F.col(key).cast("string").alias("file_key"))
    rows.write.mode("append").parquet(folder)


def shown_key(col: Column) -> Column:
    """A file key as people read it."""
    return F.url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))


#: Where files lie in subfolders that carry their keys, and what packs hold.
KEYED = "value string, file_key string"


def _files(spark: SparkSession, folder: str, suffix: str, keyed: bool, packed: bool) -> DataFrame:
    if packed:
        return spark.read.schema(KEYED).parquet(folder).select("file_key", "value")
    if keyed:
        return spark.read.schema(KEYED).text(folder, wholetext=True).select("file_key", F.rtrim("value", F.lit("\n")).alias("value"))
    return spark.read.text(f"{folder}/*.json", wholetext=True).select(file_key(suffix).alias("file_key"), "value")


def read_results(spark: SparkSession, folder: str, keyed: bool = False, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3: (good, bad) response files.

    Good ones are JSON objects: (file_key, annotation), a map of texts. Bad ones
    come with the reason: (file_key, value, reason). The key is the file's name, or with ``keyed`` its
    subfolder's, as ``write_responses`` lays them out. With ``packed`` responses stand with
    their keys in the files of ``pack_responses``, the form for many.
    """
    files = _files(spark, folder, RESULT_SUFFIX, keyed, packed)
    return good_results(files), bad_results(files)


def _reason() -> Column:
    value = F.try_parse_json("value")
    kind = F.schema_of_variant(value)
    return F.when(value.isNull(), "no JSON").when(~kind.startswith("OBJECT"), "no object")


def good_results(files: DataFrame) -> DataFrame:
    said = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    # A sentiment of another type than text is none.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.sentiment", "variant"))
    said = F.transform_values(said, lambda k, v: F.when((k != "sentiment") | (kind == "STRING"), v))
    return files.filter(_reason().isNull()).select("file_key", said.alias("annotation"))


def bad_results(files: DataFrame) -> DataFrame:
    return files.withColumn("reason", _reason()).filter("reason IS NOT NULL")


def read_metadata(spark: SparkSession, folder: str, keyed: bool = False, packed: bool = False) -> DataFrame:
    """(file_key, the metadata columns, ext) of each file; absent keys are null, unknown ones are passed over. Layouts are those of ``read_results``."""
    files = _files(spark, folder, METADATA_SUFFIX, keyed, packed)
    return files.select("file_key", F.from_json("value", METADATA_FILE).alias("m")).select("file_key", "m.*")


def _typed(value: Column, kind: T.DataType) -> Column:
    """A text as a value of ``kind``, null if it is none.

    Whole numbers may be written as 5.0. True and false are read in any case, and so are
    the numbers 1 and 0; nothing else is a boolean.
    """
    text = F.btrim(value.cast("string"))
    number = text.try_cast("double")
    if isinstance(kind, T.BooleanType):
        return F.when((F.lower(text) == "true") | (number == 1), True).when((F.lower(text) == "false") | (number == 0), False)
    if isinstance(kind, T.IntegralType):
        return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))
    return text.try_cast(kind)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` as it types them, by name, and ``broken``.

    Absent columns are null; other columns stay as they are. ``broken`` maps the names of
    values that aren't of their type to what was there, and is empty where all is well.
    """
    there = dict(df.dtypes)
    columns, bad = [], []
    for f in schema.fields:
        if f.name not in there:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif there[f.name] == f.dataType.simpleString() or isinstance(f.dataType, T.StringType):
            columns.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
        else:
            raw = F.col(f"`{f.name}`")
            value = _typed(raw, f.dataType)
            columns.append(value.alias(f.name))
            bad.append(F.when(value.isNull() & (F.btrim(raw.cast("string")) != ""), F.struct(F.lit(f.name).alias("k"), raw.cast("string").alias("v"))))
    known = {f.name for f in schema.fields}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in known and c != "broken"]
    broken = F.map_from_entries(F.filter(F.array(*bad), lambda x: x.isNotNull())) if bad else F.create_map().cast("map<string,string>")
    return df.select(*columns, *rest, broken.alias("broken"))


def read_posts(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of posts by its extension: parquet, csv, json, orc. A missing file raises.

    Columns are typed by ``schema``, by default that of the supplements' posts (``schemas.posts``),
    whatever the format, so that a flag or a number means the same in each; see ``conform`` for
    absent and other columns and for ``broken``. A CSV has a header; its quoted texts can span
    lines, and since then one file is one task, large tables are better kept as Parquet.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    schema = posts(SUPPLEMENTS) if schema is None else schema
    if kind == "csv":
        table = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    elif kind in ("json", "jsonl"):
        table = spark.read.json(path)
    elif kind in ("parquet", "orc"):
        table = spark.read.format(kind).load(path)
    else:
        raise ValueError(f"no reader for {path}")
    return conform(table, schema)


def write_links(df: DataFrame, path: str) -> None:
    """Links in order, as CSV with header."""
    df.orderBy("link").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_link_list(df: DataFrame, path: str) -> None:
    """Distinct links, one a line."""
    df.select("link").filter(F.col("link").isNotNull()).distinct().write.mode("overwrite").text(path)


def write_coding(tables: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Each named table in a folder of its own; returns the names."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return list(tables)


def write_posts(df: DataFrame, path: str) -> bool:
    """Joined posts; nothing is written, and False returned, if there are none."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True
