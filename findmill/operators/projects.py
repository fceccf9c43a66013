"""Projects and scan targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findmill.functions.text import first_text, mask_credentials, slugify, strip, text_or_empty

#: What a patch may change. Name and address of a target are fixed, as its approval is for them.
TARGET_FIELDS = (
    "is_production", "pre_approved", "auth_mode", "login_url", "username_field",
    "password_field", "auth_username", "auth_password", "context_file_path",
)


def project_upsert(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """Existing projects plus one new row per unknown (workspace, slug).

    ``requests(seq, workspace, repo_slug, name, repo_name, default_branch)``; the first
    request names the project. Slugs are compared as given. ``is_new`` tells the rows apart.
    """
    w = Window.partitionBy("workspace", "repo_slug").orderBy("seq")
    # row_number = 1 is cut per input partition before the shuffle.
    wanted = requests.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    known = projects.select("workspace", "repo_slug")
    fresh = wanted.join(known, ["workspace", "repo_slug"], "left_anti").select(
        first_text("name", "repo_name", "repo_slug").alias("name"),
        "workspace",
        "repo_slug",
        first_text("default_branch", F.lit("main")).alias("default_branch"),
        F.lit(True).alias("is_new"),
    )
    old = projects.select("name", "workspace", "repo_slug", "default_branch", F.lit(False).alias("is_new"))
    return old.unionByName(fresh)


def standalone_project(uploads: DataFrame) -> DataFrame:
    """A project per upload. The suffix is a hash of the scan id, so a rerun gives the same name."""
    named = strip(text_or_empty("name"))
    base = F.when(named == "", "upload").otherwise(named)
    slug = first_text(slugify(base), F.lit("upload"))
    suffix = F.substring(F.sha2(F.col("scan_id").cast("string"), 256), 1, 6)
    return uploads.select(
        "scan_id",
        base.alias("name"),
        F.lit("").alias("workspace"),
        F.concat(slug, F.lit("-"), suffix).alias("repo_slug"),
        F.lit("upload").alias("default_branch"),
    )


def projects_order(projects: DataFrame) -> DataFrame:
    return projects.orderBy("name")


def mask_targets(targets: DataFrame) -> DataFrame:
    return targets.withColumn("auth_password", mask_credentials("auth_password"))


def project_detail(projects: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per project and target, masked; a project without targets has one row with null target columns.

    Columns that both tables have come from the project; the target's are prefixed with ``target_``.
    """
    cols = [c for c in targets.columns if c != "project_id"]
    named = mask_targets(targets).select("project_id", *[F.col(c).alias(c if c not in projects.columns else f"target_{c}") for c in cols])
    return projects.join(named, "project_id", "left")


def target_patch(targets: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply partial updates ``patches(target_id, seq, changes map<string,string>)``.

    A key with a null value sets null; a key that is absent changes nothing. Per field the
    latest patch that names it wins, so any number of patches reduces before the join.
    Other keys are ignored; the password comes back masked.
    """
    present = [
        F.max(
            F.when(F.map_contains_key("changes", F.lit(f)), F.struct("seq", F.col("changes")[f].alias("v")))
        ).alias(f"_p_{f}")
        for f in TARGET_FIELDS
        if f in targets.columns
    ]
    latest = patches.groupBy("target_id").agg(*present)
    out = targets.join(latest, "target_id", "left")
    types = dict(targets.dtypes)
    patched = out.select(
        *[
            F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}")["v"].cast(types[c])).otherwise(F.col(c)).alias(c)
            if c in TARGET_FIELDS
            else F.col(c)
            for c in targets.columns
        ]
    )
    return mask_targets(patched) if "auth_password" in targets.columns else patched
