"""Rule governance: every manifest and rule-pack check as rows of one error table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _error(df: DataFrame, check: str, subject: Column, message: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), subject.alias("subject"), message.alias("message"))


def duplicate_rule_ids(rules: DataFrame) -> DataFrame:
    """Second and later rules with an id already seen, with the path that had it first.

    The first holder is an aggregate, so an id shared by very many rules is no hot window.
    """
    named = rules.where(F.col("rule_id").isNotNull())
    first = named.groupBy("rule_id").agg(F.min(F.struct("path", "pos")).alias("_first"))
    return (
        named.join(first, "rule_id")
        .where(F.struct("path", "pos") > F.col("_first"))
        .select("rule_id", F.col("_first.path").alias("first_path"), "path", "pos")
    )


def duplicate_source_ids(sources: DataFrame) -> DataFrame:
    ok = sources.where("pos >= 0 and id is not null and size(missing) = 0")
    first = ok.groupBy("id").agg(F.min("pos").alias("_first"))
    return ok.join(first, "id").where("pos > _first").select("id", "pos")


def effective_sources(sources: DataFrame) -> DataFrame:
    """Complete sources, the last one of an id."""
    ok = sources.where("pos >= 0 and size(missing) = 0")
    w = Window.partitionBy("id").orderBy(F.col("pos").desc())
    return ok.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rule_owner_match(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Owners per rule file: a source owns a path equal to or below one of its prefixes.

    A path is expanded to all its ancestors and equi-joined to the prefixes, so neither
    side needs to be small.
    """
    prefixes = sources.select("id", F.explode("path_prefixes").alias("p")).select(
        "id", F.regexp_replace("p", "/+$", "").alias("prefix")
    ).distinct()
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    paths = files.select("path").distinct()
    hits = paths.select("path", F.explode(ancestors).alias("prefix")).join(prefixes, "prefix")
    owners = hits.groupBy("path").agg(F.countDistinct("id").alias("owners"), F.min("id").alias("owner"))
    return paths.join(owners, "path", "left").select(
        "path", F.coalesce("owners", F.lit(0)).alias("owners"), F.when(F.col("owners") == 1, F.col("owner")).alias("owner")
    )


def rule_counts(rules: DataFrame, owners: DataFrame) -> DataFrame:
    """Rules with an id per owning source."""
    counted = rules.where(F.col("rule_id").isNotNull()).join(owners.where("owners = 1"), "path")
    return counted.groupBy(F.col("owner").alias("id")).agg(F.count(F.lit(1)).alias("rules"))


def rule_count_reconcile(sources: DataFrame, counts: DataFrame) -> DataFrame:
    found = F.coalesce("rules", F.lit(0))
    return sources.join(counts, "id", "left").select(
        "id", "expected_rule_count", found.alias("found"), (found == F.col("expected_rule_count")).alias("matches")
    )


def rule_hash_verify(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored SHA-256 against the bytes; ``status`` is ok, mismatch or unreadable."""
    wanted = sources.select("id", F.explode("hashes").alias("path", "expected"))
    actual = documents.select("path", F.sha2("content", 256).alias("actual"))
    status = (
        F.when(F.col("actual").isNull(), "unreadable").when(F.col("actual") != F.col("expected"), "mismatch").otherwise("ok")
    )
    return wanted.join(actual, "path", "left").select("id", "path", status.alias("status"))


def rule_metadata_check(rules: DataFrame, governed: DataFrame | None = None) -> DataFrame:
    """Missing or wrong metadata, one row per fault."""
    r = rules.where(F.col("rule_id").isNotNull())
    if governed is not None:
        r = r.join(governed.select("rule_id").distinct(), "rule_id", "left_semi")

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    def none(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) <= 0

    faults = {
        "license": F.coalesce(F.col("license"), F.lit("")) != "MIT",
        "confidence": ~F.coalesce(F.col("confidence").isin("HIGH", "MEDIUM"), F.lit(False)),
        "cwe": none("cwe"),
        "owasp": none("owasp"),
        "references": none("references"),
        "remediation": blank("remediation"),
    }
    listed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in faults.items()]))
    return r.select("rule_id", "path", F.explode(listed).alias("field"))


def rule_governance(sources: DataFrame, rules: DataFrame, documents: DataFrame) -> DataFrame:
    """All checks; a sound rule pack gives no rows."""
    good = effective_sources(sources)
    owners = rule_owner_match(documents, good)
    owned = rules.join(owners.where("owners = 1").select("path"), "path", "left_semi")
    counts = rule_counts(owned, owners)
    path, rid = F.col("path"), F.col("id")
    parts = [
        _error(sources.where("file_error is not null"), "manifest", F.lit("manifest"), F.col("file_error")),
        _error(
            sources.where("pos >= 0 and size(missing) > 0"), "source_fields", F.coalesce(rid, F.lit("")),
            F.concat(F.lit("source missing required fields "), F.array_join("missing", ", ")),
        ),
        _error(duplicate_source_ids(sources), "source_id", rid, F.concat(F.lit("duplicate source id: "), rid)),
        _error(
            owners.where("owners <> 1"), "owner", path,
            F.concat(path, F.lit(": expected exactly one manifest owner, got "), F.col("owners").cast("string")),
        ),
        _error(owned.where("file_error is not null"), "file", path, F.concat(path, F.lit(": "), F.col("file_error"))),
        _error(owned.where("file_error is null and rule_id is null"), "rule_id", path, F.concat(path, F.lit(": rule missing id"))),
        _error(
            duplicate_rule_ids(owned), "duplicate", F.col("rule_id"),
            F.concat(F.lit("duplicate rule id "), F.col("rule_id"), F.lit(": "), F.col("first_path"), F.lit(" and "), path),
        ),
        _error(
            rule_count_reconcile(good, counts).where("not matches"), "count", rid,
            F.concat(F.lit("source "), rid, F.lit(": expected "), F.col("expected_rule_count").cast("string"),
                     F.lit(" rules, found "), F.col("found").cast("string")),
        ),
        _error(
            rule_hash_verify(good, documents).where("status <> 'ok'"), "hash", path,
            F.concat(path, F.when(F.col("status") == "mismatch", ": SHA-256 mismatch").otherwise(": cannot verify hash")),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
