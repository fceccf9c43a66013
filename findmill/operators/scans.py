"""Scan planning, admission, engine outcomes, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill import constants as K
from findmill.functions.text import col, first_text, is_rate_limited, retry_after, text_or_empty
from findmill.functions.findings import literal_map
from findmill.operators.projects import standalone_project
from findmill.operators.summary import scan_summary, scan_verdict


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def engine_run_classify(runs: DataFrame) -> DataFrame:
    """Outcome of engine runs: adds ``state, kind, reason``.

    ``runs`` has engine, exit_code, stderr, timed_out, and retry_exit_code and retry_stderr for
    the one offline retry of a rate-limited dependency scan.
    """
    engine, code = F.col("engine"), F.col("exit_code")
    ok = F.when(engine == "trivy", code == 0).otherwise(code.isin(0, 1))
    retried = (engine == "trivy") & (code != 0) & is_rate_limited("stderr")
    degraded = retried & (F.col("retry_exit_code") == 0)
    also = F.when(
        retried & F.col("retry_exit_code").isNotNull() & (F.col("retry_exit_code") != 0),
        F.concat(F.lit(K.RETRY_FAILED_MESSAGE), F.substring(text_or_empty("retry_stderr"), 1, 120)),
    ).otherwise("")
    wait = retry_after(F.substring("stderr", 1, 300))
    kind = (
        F.when(F.col("timed_out"), "timeout")
        .when(code.isNull(), "unavailable")
        .when(degraded, "degraded")
        .when(ok, "")
        .when((engine == "opengrep") & code.between(2, 8), "rule_config")
        .otherwise("execution")
    )
    out = runs.withColumn("kind", kind)
    k = F.col("kind")
    return out.withColumn(
        "state", F.when(k.isin("", "degraded"), "done").when(k == "unavailable", "unavailable").otherwise("failed")
    ).withColumn(
        "reason",
        F.when(k == "", "")
        .when(k == "timeout", F.concat(engine, F.lit(" timed out")))
        .when(k == "unavailable", F.concat(engine, F.lit(" executable not found")))
        .when(
            k == "degraded",
            F.concat(
                F.lit(K.DEGRADED_MESSAGE),
                F.when(wait != "", F.concat(F.lit(" Retry-After: "), wait, F.lit("."))).otherwise(""),
            ),
        )
        .when(
            k == "rule_config",
            F.concat(
                engine, F.lit(" rule/config error (exit "), code.cast("string"), F.lit("): "),
                F.substring(text_or_empty("stderr"), 1, 300),
            ),
        )
        .otherwise(
            F.concat(
                engine, F.lit(" exited "), code.cast("string"), F.lit(": "), F.substring(text_or_empty("stderr"), 1, 300), also
            )
        ),
    )


def resolve_engines(engines: Column | str, scan_type: Column | str) -> Column:
    """Engines of a scan: the known ones of its list, else the default of its type."""
    given = F.split(text_or_empty(engines), ",")
    known = F.filter(given, lambda e: e.isin(*K.ENGINE_SOURCE_TYPE))
    default = F.coalesce(*[F.when(col(scan_type) == t, _names(v)) for t, v in K.DEFAULT_ENGINES.items()], _names(K.SAST_ENGINES))
    return F.when(text_or_empty(engines) != "", known).otherwise(default)


def engine_plan(scans: DataFrame) -> DataFrame:
    """One row per planned engine with a skip reason where it cannot apply.

    ``scans`` has engines, scan_type, has_checkout, languages, has_rules, zap_reachable.
    """
    planned = scans.withColumn("engine", F.explode(resolve_engines("engines", "scan_type")))
    e = F.col("engine")
    no_checkout = ~F.col("has_checkout") & (e != "zap")
    reason = (
        F.when((e == "zap") & ~F.col("zap_reachable"), "zap is not reachable (is ZAP running at the configured API URL?)")
        .when(no_checkout, F.concat(e, F.lit(" requires a local checkout")))
        .when(
            (e == "bandit") & ~F.array_contains("languages", "python"), "bandit is skipped: no Python files detected"
        )
        .when(
            (e == "opengrep") & ~F.col("has_rules"),
            "opengrep is skipped: no matching local rules for the detected languages",
        )
    )
    return planned.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn(
        "state", F.when(reason.isNotNull(), "skipped").otherwise("running")
    )


def engine_dim_join(runs: DataFrame) -> DataFrame:
    """Source type of each engine; the dimension is five fixed entries and becomes a literal."""
    return runs.withColumn("source_type", F.try_element_at(literal_map(K.ENGINE_SOURCE_TYPE), F.col("engine")))


def compatible_engines(scan_type: Column | str) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(*[F.when(col(scan_type) == t, _names(v)) for t, v in K.ENGINE_COMPAT.items()], none)


def unknown_engines(engines: Column | str) -> Column:
    """Requested engines that do not exist, each once."""
    return F.array_except(col(engines), _names(K.ENGINE_SOURCE_TYPE))


def target_lookup(scans: DataFrame, targets: DataFrame) -> DataFrame:
    """Scan with its target; a target of another project counts as missing.

    Scans without a target are the most, so they are spread by a hash in a second key.
    """
    t = targets.select(
        F.lit(0).cast("long").alias("_none"), F.col("target_id"), F.col("project_id").alias("_tp"), F.col("url").alias("target_url"), "is_production", "pre_approved"
    )
    wanted = scans.withColumn("_tid", F.col("dast_target").try_cast("long"))
    plain = [f.name for f in scans.schema.fields if not f.dataType.simpleString().startswith(("map", "variant", "struct", "array"))]
    wanted = wanted.withColumn("_spread", F.when(F.col("_tid").isNull(), F.xxhash64(*plain)).otherwise(0))
    joined = wanted.join(t, (wanted["_tid"] == t["target_id"]) & (wanted["_spread"] == t["_none"]), "left")
    own = F.col("_tp") == F.col("project_id")
    return joined.select(
        *scans.columns,
        F.when(own, F.col("target_url")).alias("target_url"),
        F.coalesce(own, F.lit(False)).alias("target_found"),
        F.when(own, F.col("is_production")).alias("is_production"),
        F.when(own, F.col("pre_approved")).alias("pre_approved"),
    )


def scan_ref_default(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """A branch scan without a ref takes the default branch of its project."""
    p = projects.select("project_id", F.col("default_branch").alias("_default"))
    out = requests.join(p, "project_id", "left")
    empty = (F.col("ref_type") == "branch") & (text_or_empty("ref_name") == "")
    return out.withColumn("ref_name", F.when(empty, F.col("_default")).otherwise(F.col("ref_name"))).drop("_default")


def scan_head_commit(scans: DataFrame, projects: DataFrame, pulls: DataFrame) -> DataFrame:
    """A pull-request scan takes the head commit of its request; one that the catalog lacks has a blank commit.

    ``pulls(workspace, repo_slug, id, commit)``, one row per request (``catalog_pull_requests`` of every state).
    """
    p = projects.select("project_id", F.col("workspace").alias("_ws"), F.col("repo_slug").alias("_slug"))
    heads = pulls.select(F.col("workspace").alias("_ws"), F.col("repo_slug").alias("_slug"), F.col("id").alias("_id"), F.col("commit").alias("_head"))
    asked = F.when(F.col("ref_type") == "pr", F.col("ref_name").try_cast("long"))
    out = scans.join(p, "project_id", "left").withColumn("_id", asked).join(heads, ["_ws", "_slug", "_id"], "left")
    head = F.when(F.col("ref_type") == "pr", text_or_empty("_head")).otherwise(F.col("commit_sha"))
    return out.select(*[head.alias(c) if c == "commit_sha" else F.col(c) for c in scans.columns])


#: What a direct request says about its target.
_TARGET_COLUMNS = (
    "url", "is_production", "pre_approved", "auth_mode", "login_url", "username_field", "password_field", "auth_username", "auth_password", "context_file_path",
)


def direct_dast(requests: DataFrame) -> dict[str, DataFrame]:
    """Scans of an address without a catalog project: ``decisions`` on all requests; ``projects``, ``targets`` and ``scans`` of the accepted ones.

    ``requests(scan_id, name, url, is_production, pre_approved, dast_confirmed, ...)``; login columns may be missing. Each
    accepted request has a project and a target of its own, both found under the scan's id. Tables are small projections of
    one input, so that each can be written by itself.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when(yes("is_production") & ~yes("dast_confirmed"), "target is production: you must confirm active scanning explicitly").when(
        ~yes("pre_approved") & ~yes("dast_confirmed"), "target is not pre-approved: confirm to run active scan"
    )
    judged = requests.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("decision", F.when(reason.isNull(), "accepted").otherwise("rejected"))
    accepted = judged.where("decision = 'accepted'")
    named = accepted.withColumn("name", first_text("name", "url"))
    projects = standalone_project(named)
    blank = {c: F.lit("") for c in _TARGET_COLUMNS if c not in requests.columns}
    targets = named.withColumns(blank).select(F.col("scan_id").alias("target_id"), F.col("scan_id").alias("project_scan_id"), "name", *_TARGET_COLUMNS)
    scans = projects.select(
        "scan_id", F.lit("dast").alias("scan_type"), F.lit("zap").alias("engines"), F.lit("upload").alias("ref_type"), F.col("name").alias("ref_name"),
        F.col("scan_id").cast("string").alias("dast_target"), F.lit("pending").alias("status"),
    )
    return {"decisions": judged.select("scan_id", "decision", "reason"), "projects": projects, "targets": targets, "scans": scans}


def scan_admission(requests: DataFrame, projects: DataFrame, targets: DataFrame) -> DataFrame:
    """First rule each scan request breaks, as ``decision, reason``."""
    p = projects.select("project_id", F.col("workspace").alias("_ws"))
    known = requests.join(p, "project_id", "left")
    full = target_lookup(known, targets)
    dast = F.col("scan_type") == "dast"
    unknown = unknown_engines("engines")
    reason = (
        F.when(F.col("_ws").isNull(), F.lit("project not found"))
        .when(
            (F.col("_ws") == "") & F.col("ref_type").isin("branch", "pr"),
            "uploaded projects cannot be rescanned as branch/PR; upload a new ZIP to scan a new snapshot",
        )
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown engines: "), F.array_join(unknown, ", ")))
        .when(dast & F.col("dast_target").isNull(), "dast scans require a configured target")
        .when(dast & ~F.col("target_found"), "target not found for this project")
        .when(
            dast & F.col("is_production") & ~F.col("dast_confirmed"),
            "target is production: you must confirm active scanning explicitly",
        )
        .when(
            dast & ~F.col("pre_approved") & ~F.col("dast_confirmed"),
            "target is not pre-approved: confirm to run active scan",
        )
    )
    return full.select(
        *requests.columns,
        F.when(reason.isNull(), "accepted").otherwise("rejected").alias("decision"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )


def upload_admission(uploads: DataFrame, max_bytes: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    """Resolve presets and give the first rule an upload breaks.

    ``uploads`` has preset, scan_type, engines array, filename, size_bytes.
    """
    preset = text_or_empty("preset")
    asked = F.filter(F.col("engines"), lambda e: F.coalesce(e, F.lit("")) != "")
    named = preset.isin(*K.UPLOAD_PRESETS)
    preset_type = F.coalesce(*[F.when(preset == p, t) for p, (t, _) in K.UPLOAD_PRESETS.items()])
    preset_engines = F.coalesce(*[F.when(preset == p, _names(e)) for p, (_, e) in K.UPLOAD_PRESETS.items()])
    typed = uploads.withColumn("_asked", F.when(named, preset_engines).otherwise(asked)).withColumn(
        "resolved_type", F.when(named, preset_type).otherwise(F.col("scan_type"))
    )
    compat = compatible_engines("resolved_type")
    full = typed.withColumn(
        "resolved_engines", F.when(F.size("_asked") == 0, compat).otherwise(F.col("_asked"))
    )
    unknown = unknown_engines("resolved_engines")
    misfit = F.array_except("resolved_engines", compat)
    reason = (
        F.when((preset != "") & ~named & (preset != "custom"), F.concat(F.lit("unknown preset: "), preset))
        .when((preset == "custom") & (F.size("_asked") == 0), "custom preset requires at least one engine")
        .when(~F.col("resolved_type").isin(*K.ENGINE_COMPAT), "scan_type must be one of full, sast, sca, secrets")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown engines: "), F.array_join(unknown, ", ")))
        .when(F.array_contains("resolved_engines", "zap"), "zap is only available for DAST scans")
        .when(F.size(misfit) > 0, F.concat(F.lit("engines not valid for scan_type: "), F.array_join(misfit, ", ")))
        .when(~F.lower(text_or_empty("filename")).endswith(".zip"), "please upload a .zip archive")
        .when(F.col("size_bytes") > max_bytes, F.lit(f"upload exceeds the maximum size of {max_bytes} bytes"))
    )
    return full.select(
        *uploads.columns,
        "resolved_type",
        "resolved_engines",
        F.when(reason.isNull(), "accepted").otherwise("rejected").alias("decision"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )


def recover_stale_scans(scans: DataFrame, at: Column) -> DataFrame:
    """Scans that were waiting or running at a restart become failed; ``recovered`` marks them."""
    stale = F.col("status").isin("pending", "running")
    return scans.select(
        *[c for c in scans.columns if c not in ("status", "error", "finished_at")],
        F.when(stale, "failed").otherwise(F.col("status")).alias("status"),
        F.when(stale, K.RECOVERY_MESSAGE).otherwise(F.col("error")).alias("error"),
        F.when(stale, at).otherwise(F.col("finished_at")).alias("finished_at"),
        stale.alias("recovered"),
    )


def engine_states(runs: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Final state of each (scan, engine): what became of the run, and of its report.

    ``runs`` as ``engine_run_classify`` takes them, with scan_id; ``envelopes(scan_id, engine, kind, reason)`` of
    ``ingest_report_envelope``. An engine that ran well but whose report is quarantined has failed.
    """
    bad = envelopes.where("kind is not null").groupBy("scan_id", "engine").agg(F.min(F.struct("kind", "reason")).alias("_bad"))
    out = engine_run_classify(runs).join(bad, ["scan_id", "engine"], "left")
    spoilt = (F.col("state") == "done") & F.col("_bad").isNotNull()
    return out.select(
        "scan_id", "engine",
        F.when(spoilt, "failed").otherwise(F.col("state")).alias("state"),
        F.when(spoilt, F.col("_bad.kind")).otherwise(F.col("kind")).alias("kind"),
        F.when(spoilt, F.concat("engine", F.lit(": "), F.col("_bad.reason"))).otherwise(F.col("reason")).alias("reason"),
    )


def completed_findings(found: DataFrame, states: DataFrame) -> DataFrame:
    """Findings of engines that are done; failed engines contribute nothing, others are kept."""
    done = states.where("state = 'done'").select("scan_id", F.col("engine").alias("tool"))
    return found.join(done, ["scan_id", "tool"], "left_semi")


def scan_outcome(states: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """The end of each scan: status, error, engine_statuses and summary, one row per scan of ``states``.

    ``states`` of ``engine_states`` (and skipped engines of ``engine_plan``), ``found(scan_id, tool)`` findings as the
    engines gave them, ``kept(scan_id, severity)`` those left after deduplication. Findings are counted before they meet
    the engines, of which a scan has five at most.
    """
    counts = found.groupBy("scan_id", F.col("tool").alias("engine")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    counted = states.join(counts, ["scan_id", "engine"], "left")
    done = F.col("state") == "done"
    entry = F.struct(
        F.col("state"), F.when(done, F.coalesce("n", F.lit(0))).alias("findings"),
        F.when(F.col("reason") != "", F.col("reason")).alias("reason"), F.when(F.col("kind") != "", F.col("kind")).alias("kind"),
    )
    by_engine = counted.groupBy("scan_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("engine"), entry)))).alias("engine_statuses"))
    summed = scan_summary(kept, states).select("scan_id", F.struct("total", "by_severity", "engines").alias("summary"))
    return scan_verdict(states).join(by_engine, "scan_id").join(summed, "scan_id")


def finish_scans(scans: DataFrame, outcome: DataFrame, finished_at: Column) -> DataFrame:
    """Scan rows after their end; scans without an outcome stay as they are."""
    new = outcome.select("scan_id", *[F.col(c).alias(f"_{c}") for c in ("status", "error", "engine_statuses", "summary")])
    ended = F.col("_status").isNotNull()
    out = scans.join(new, "scan_id", "left")
    for c in ("status", "error", "engine_statuses", "summary"):
        out = out.withColumn(c, F.when(ended, F.col(f"_{c}")).otherwise(F.col(c)) if c in scans.columns else F.col(f"_{c}"))
    old = F.col("finished_at") if "finished_at" in scans.columns else F.lit(None).cast("timestamp")
    return out.withColumn("finished_at", F.when(ended, finished_at).otherwise(old)).drop("_status", "_error", "_engine_statuses", "_summary")
