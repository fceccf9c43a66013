"""Archive safety audit on member listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill import constants as K
from findmill.functions.findings import member_type


def archive_totals(members: DataFrame) -> DataFrame:
    """Files, bytes and largest compression ratio per archive."""
    real = members.where("pos >= 0").withColumn("type", member_type("filename", "external_attr"))
    is_file = F.col("type") == "file"
    sized = is_file & (F.col("file_size") > 0) & (F.col("compress_size") > 0)
    return real.groupBy("archive_id").agg(
        F.count_if(is_file).alias("files"),
        F.coalesce(F.sum(F.when(is_file, F.col("file_size"))), F.lit(0)).alias("bytes"),
        F.max(F.when(sized, F.col("file_size") / F.col("compress_size"))).alias("max_ratio"),
    )


def archive_audit(
    members: DataFrame,
    max_files: int = K.MAX_ARCHIVE_FILES,
    max_bytes: int = K.MAX_EXPANDED_BYTES,
    max_file_bytes: int = K.MAX_FILE_BYTES,
    max_ratio: int = K.MAX_COMPRESSION_RATIO,
) -> DataFrame:
    """First rule each archive breaks. Member rows fold to one row per archive map-side.

    Unsafe names are reported by the first offending member, whichever of the two name
    rules it breaks; size and ratio likewise.
    """
    name = F.translate("filename", "\\", "/")
    real = F.col("pos") >= 0
    absolute = name.startswith("/") | (F.locate("\u0000", name) > 0)
    climbs = F.array_contains(F.split(name, "/"), "..")
    typed = members.withColumn("type", member_type("filename", "external_attr"))
    is_file = F.col("type") == "file"
    ratio = (F.col("file_size") > 0) & (F.col("compress_size") > 0) & (
        F.col("file_size") / F.col("compress_size") > max_ratio
    )
    first = lambda cond, *what: F.min(F.when(cond, F.struct("pos", *what)))
    folded = typed.groupBy("archive_id").agg(
        F.max("archive_error").alias("_bad"),
        F.count_if(real).alias("_members"),
        first(real & (absolute | climbs), F.when(absolute, "unsafe archive entry").otherwise(
            "archive contains a path-traversal entry").alias("why")).alias("_name"),
        F.count_if(real & F.col("type").isin("symlink", "special")).alias("_odd"),
        F.count_if(real & is_file).alias("_files"),
        F.coalesce(F.sum(F.when(real & is_file, F.col("file_size"))), F.lit(0)).alias("_bytes"),
        first(real & is_file & ((F.col("file_size") > max_file_bytes) | ratio), F.when(
            F.col("file_size") > max_file_bytes, "file too large"
        ).otherwise("archive entry has an excessive compression ratio").alias("why")).alias("_size"),
    )
    reason = (
        F.when(F.col("_bad").isNotNull(), F.col("_bad"))
        .when(F.col("_members") == 0, "zip archive is empty")
        .when(F.col("_name").isNotNull(), F.col("_name")["why"])
        .when(F.col("_odd") > 0, "unsupported archive entry type")
        .when(F.col("_files") > max_files, "archive has too many files")
        .when(F.col("_bytes") > max_bytes, "archive expands beyond the allowed size")
        .when(F.col("_size").isNotNull(), F.col("_size")["why"])
    )
    return folded.select(
        "archive_id",
        F.when(reason.isNull(), "accepted").otherwise("rejected").alias("decision"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )


def common_root_strip(members: DataFrame) -> DataFrame:
    """Add ``target``: the member name without a top directory that all files share.

    One directory is shared when the smallest and largest top name agree.
    """
    is_file = (F.col("filename") != "") & ~F.col("filename").endswith("/")
    top = F.when(is_file, F.substring_index("filename", "/", 1))
    roots = members.groupBy("archive_id").agg(
        F.min(top).alias("_root"),
        ((F.min(top) == F.max(top)) & F.bool_and(F.when(is_file, F.col("filename").contains("/")))).alias("_strip"),
    )
    out = members.join(roots, "archive_id")
    cut = F.substring("filename", F.length("_root") + 2, F.length("filename"))
    return out.withColumn("target", F.when(F.coalesce("_strip", F.lit(False)), cut).otherwise(F.col("filename"))).drop(
        "_root", "_strip"
    )
