"""Source trees as tables: files, numbered lines, languages per project."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill import constants as K
from findmill.functions.findings import literal_map, path_suffix


def read_source_files(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Files below ``root`` as ``(path, content)``; bytes that are not UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    full = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    return raw.select(
        F.substring(full, len(root.rstrip("/")) + 2, 1 << 30).alias("path"),
        F.decode(F.col("content"), "UTF-8").alias("content"),
    )


def store_sources(files: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write ``files(project, path, content, ...)`` bucketed and sorted by project and path, and read them as such.

    Texts are dealt out once, here: joins on (project, path) with the stored table leave them where they are, so every
    job that looks lines up afterwards moves findings only. ``open_sources`` finds the table in a later session.
    """
    dealt = files.repartition(buckets, "project", "path")
    name = _table_name()
    dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, "project", "path").sortBy("project", "path").option("path", path).saveAsTable(name)
    return files.sparkSession.table(name)


def open_sources(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A table that ``store_sources`` wrote to ``path`` with so many buckets."""
    name = _table_name()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (project, path) SORTED BY (project, path) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def _table_name() -> str:
    return f"sources_{uuid.uuid4().hex[:12]}"


def line_pieces(body: Column) -> Column:
    """Lines of a text as they are between line feeds; a last empty one isn't a line, an empty text has none."""
    ended = F.when(body.endswith("\n"), F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    return F.when(body != "", F.split(ended, "\n"))


def line_text(piece: Column) -> Column:
    return F.regexp_replace(piece, r"\r+\z", "")


def source_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """Numbered lines of every file, 1-based; carriage returns at the end are dropped.

    ``bytes`` is the length before that, as the context limits count it.
    """
    keys = [c for c in files.columns if c != text]
    return files.select(*keys, F.posexplode(line_pieces(F.col(text))).alias("pos", "piece")).select(
        *keys,
        (F.col("pos") + 1).alias("line"),
        line_text(F.col("piece")).alias("text"),
        F.octet_length("piece").alias("bytes"),
    )


def language_of(path: Column | str) -> Column:
    return F.try_element_at(literal_map(K.EXTENSION_LANGUAGE), path_suffix(path))


def is_hidden(path: Column | str) -> Column:
    """Any path part that starts with a dot."""
    return (F.col(path) if isinstance(path, str) else path).rlike(r"(?:^|/)\.")


def languages_order(langs: Column | str) -> Column:
    """Known languages by priority, the rest by name after them."""
    arr = F.col(langs) if isinstance(langs, str) else langs
    rank = literal_map(K.LANGUAGE_PRIORITY)
    keyed = F.transform(
        arr, lambda x: F.struct(F.coalesce(F.try_element_at(rank, x), F.lit(99)).alias("p"), x.alias("n"))
    )
    return F.transform(F.array_sort(keyed), lambda s: s["n"])


def supported_languages(langs: Column | str) -> Column:
    """Languages the pattern engine has rules for, in the order given."""
    arr = F.col(langs) if isinstance(langs, str) else langs
    return F.array_intersect(arr, F.array(*[F.lit(x) for x in K.RULE_LANGUAGES]))


def language_inventory(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Ordered languages per project. The set per project is bounded by the suffix table.

    ``overrides(project, language_override)``: a value that is not empty replaces the set.
    """
    found = (
        files.where(~is_hidden("path"))
        .select("project", language_of("path").alias("lang"))
        .where(F.col("lang").isNotNull())
        .groupBy("project")
        .agg(languages_order(F.collect_set("lang")).alias("languages"))
    )
    if overrides is None:
        return found
    given = F.nullif(F.col("language_override"), F.lit(""))
    return found.join(overrides, "project", "full_outer").select(
        "project",
        F.when(given.isNotNull(), F.array(given))
        .otherwise(F.coalesce("languages", F.array().cast("array<string>")))
        .alias("languages"),
    )
