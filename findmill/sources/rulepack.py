"""Rule packs and their manifest: YAML documents -> tables, and rule selection."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findmill import constants as K

SOURCE_REQUIRED = ("id", "repository", "license", "revision", "profile", "path_prefixes", "expected_rule_count")


def read_documents(spark: SparkSession, glob: str, root: str) -> DataFrame:
    """YAML files as ``(path, content binary)``, paths relative to ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    full = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    return raw.where(F.lower("path").rlike(r"\.y[^/]*ml$")).select(
        F.substring(full, len(root.rstrip("/")) + 2, 1 << 30).alias("path"), "content"
    )


def _decoded(body) -> tuple[str | None, str | None]:
    """(JSON text, error) of a YAML document; nothing in it is judged here."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        doc = yaml.load(bytes(body) if isinstance(body, (bytes, bytearray)) else body, Loader=loader)
        return json.dumps(doc, default=str, allow_nan=False), None
    except (yaml.YAMLError, UnicodeDecodeError, TypeError, ValueError, RecursionError) as exc:
        return None, f"invalid YAML: {type(exc).__name__}"


def _yaml_as_json(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the document as variant ``v`` and its decoding ``error``."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_decoded(body) for body in batch["content"]]
            yield batch[keep].assign(doc=[d for d, _ in found], error=[e for _, e in found])

    kept = "".join(f"{c} string, " for c in keep)
    rows = documents.select(*keep, "content").mapInPandas(decode, f"{kept}doc string, error string")
    v = F.try_parse_json("doc")
    return rows.select(*keep, v.alias("v"), F.when(F.col("error").isNull() & v.isNull(), "invalid YAML: not representable").otherwise(F.col("error")).alias("error"))


def _text(v: Column, path: str) -> Column:
    """A value as text; lists and maps as their JSON."""
    return F.try_variant_get(v, path, "string")


def _texts(v: Column, path: str) -> Column:
    """A list of texts; a single value is a list of one."""
    listed = F.try_variant_get(v, path, "array<string>")
    one = _text(v, path)
    return F.coalesce(F.array_compact(listed), F.when(one.isNotNull(), F.array(one)), F.expr("cast(array() as array<string>)"))


def _pattern_tree(rule_json: str | None) -> tuple[list[str], list[str], list[str]]:
    """Regexes, call patterns and the operators that a list of alternatives cannot express."""
    regexes, patterns, beyond = [], [], []
    work = [json.loads(rule_json)] if rule_json else []
    while work:
        node = work.pop(0)
        if isinstance(node, list):
            work[:0] = node
            continue
        if not isinstance(node, dict):
            continue
        for key, value in node.items():
            if not key.startswith(("pattern", "metavariable", "focus-metavariable")):
                continue
            if key == "pattern-regex" and isinstance(value, str):
                regexes.append(value)
            elif key == "pattern" and isinstance(value, str):
                patterns.append(value)
            elif key == "pattern-either" or key == "patterns" and isinstance(value, list) and len(value) == 1:
                work.insert(0, value)
            else:
                beyond.append(key)
                work.insert(0, value)
    return regexes, patterns, beyond


def rule_pack_load(documents: DataFrame) -> DataFrame:
    """One row per rule; a file that cannot be used gives one row with ``file_error``.

    ``unsupported`` lists operators of a rule that demand more than one of several patterns; such rules are not
    used for detection. Values of an unexpected type become text or null and never end the job.
    """
    listed = F.try_variant_get("v", "$.rules", "array<variant>")
    # parsing costs far more than reading, so documents are dealt out first: a few large files would be a few tasks
    files = _yaml_as_json(documents.repartition("path"), ["path"]).select("path", listed.alias("rules"), F.when(F.col("error").isNull() & listed.isNull(), K.RULES_NOT_LISTED).otherwise(F.col("error")).alias("file_error"))
    rows = files.select("path", "file_error", F.posexplode_outer(F.when(F.col("file_error").isNull(), F.col("rules")).otherwise(F.expr("cast(null as array<variant>)"))).alias("pos", "r"))
    rows = rows.where("file_error is not null or pos is not null").withColumn("pos", F.coalesce("pos", F.lit(-1)))
    r = F.col("r")

    rid = _text(r, "$.id")
    empty = rid.isin("", "0", "false") & ~F.coalesce(F.schema_of_variant(F.try_variant_get(r, "$.id", "variant")) == "STRING", F.lit(False)) | (rid == "")
    meta = {c: _text(r, f"$.metadata.{c}") for c in ("category", "confidence", "license", "remediation")} | {c: _texts(r, f"$.metadata.{c}") for c in ("cwe", "owasp", "references")}
    flat = rows.select(
        "path", "pos", F.when(~empty, rid).alias("rule_id"), _texts(r, "$.languages").alias("languages"), _text(r, "$.message").alias("message"),
        _text(r, "$.severity").alias("severity"), *[c.alias(n) for n, c in meta.items()], "file_error", F.to_json("r").alias("_json"),
    )
    # a function of one column, so that a plan which reads none of its results does not call it
    tree = F.udf(_pattern_tree, "struct<regexes array<string>, patterns array<string>, unsupported array<string>>", useArrow=False)
    flat = flat.withColumn("_tree", tree("_json")).select("*", "_tree.*")
    return flat.select("path", "pos", "rule_id", "languages", "message", "severity", "category", "cwe", "owasp", "confidence", "license", "references", "remediation", "regexes", "patterns", "unsupported", "file_error")


def manifest_load(documents: DataFrame) -> DataFrame:
    """One row per declared source of every manifest document; an unusable manifest gives one row with ``file_error``."""
    sources = F.try_variant_get("v", "$.sources", "array<variant>")
    sound = (F.try_variant_get("v", "$.version", "double") == 1) & (F.size(sources) > 0)
    error = F.when(F.col("error").isNotNull(), F.concat(F.lit("manifest unreadable: "), "error")).when(~F.coalesce(sound, F.lit(False)), K.MANIFEST_UNSOUND)
    rows = _yaml_as_json(documents, []).select(error.alias("file_error"), sources.alias("s"))
    rows = rows.select("file_error", F.posexplode_outer(F.when(F.col("file_error").isNull(), F.col("s")).otherwise(F.expr("cast(null as array<variant>)"))).alias("pos", "s"))
    s = F.col("s")
    texts = {c: _text(s, f"$.{c}") for c in SOURCE_REQUIRED}
    missing = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit("")).isin("", "[]", "{}"), c) for c, t in texts.items()]))
    hashes = F.coalesce(F.try_variant_get(s, "$.hashes", "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    listed = F.col("file_error").isNull()
    return rows.select(
        F.when(listed, 1).alias("version"), F.coalesce("pos", F.lit(-1)).alias("pos"), *[F.when(texts[c] != "", texts[c]).alias(c) for c in ("id", "repository", "license", "revision", "profile")],
        F.when(listed, _texts(s, "$.path_prefixes")).alias("path_prefixes"), F.try_variant_get(s, "$.expected_rule_count", "int").alias("expected_rule_count"),
        F.when(listed, hashes).alias("hashes"), F.when(listed, missing).alias("missing"), "file_error",
    )


def distinct_rule_files(files: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First file per path in the given order."""
    w = Window.partitionBy(*keys, "path").orderBy(*order)
    return files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rule_pack_select(files: DataFrame, project_languages: DataFrame) -> DataFrame:
    """Rule files for every project: common, then its languages in order, then vendor.

    ``files(path)`` and ``project_languages(project, languages array)`` give
    ``(project, group_ord, ext_ord, path)``, each path once per project. Files are chosen once per distinct list
    of languages (``rule_lists``), projects only join their list.
    """
    lists = rule_lists(files, project_languages.select("languages").distinct())
    return project_languages.join(lists, "languages").select("project", "group_ord", "ext_ord", "path")


def rule_lists(files: DataFrame, languages: DataFrame) -> DataFrame:
    """``(languages, group_ord, ext_ord, path)`` per list of languages, each path once."""
    parts = F.split("path", "/")
    top = F.element_at(parts, 1)
    ext_ord = F.when(F.col("path").endswith(".yaml"), 0).when(F.col("path").endswith(".yml"), 1)
    listed = files.select("path", top.alias("dir"), F.size(parts).alias("depth"), ext_ord.alias("ext_ord")).where(
        "ext_ord is not null and (dir = 'vendor' or depth = 2)"
    )
    wanted_dirs = F.concat(F.array(F.lit("common")), F.col("languages"), F.array(F.lit("vendor")))
    wanted = languages.select("languages", F.posexplode(wanted_dirs).alias("group_ord", "dir"))
    picked = wanted.join(listed, "dir").select("languages", "group_ord", "ext_ord", "path")
    return distinct_rule_files(picked, ["languages"], ["group_ord", "ext_ord"])
