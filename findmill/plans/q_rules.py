"""Registered queries: rule packs, their manifest, governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from findmill.operators import governance as g
from findmill.plans import views as v
from findmill.plans.q_lines import _D_LANG_TEXT
from findmill.session import materialise
from findmill.sources import corpus, rulepack

Q: dict = {}


def _docs(spark, sf):
    return v.rule_files(spark, sf)


def _rules(spark, sf):
    return rulepack.rule_pack_load(_docs(spark, sf))


def _parsed(spark, sf):
    """Parsed rules for plans that read them more than once."""
    return materialise(_rules(spark, sf), "rules")


def _sources(spark, sf):
    return rulepack.manifest_load(v.manifests(spark, sf))


def _good(spark, sf):
    return g.effective_sources(_sources(spark, sf))


# Rule files as the checking engine sees them: what is wrong with each and who owns it.
_F = (
    "SELECT pk, path, CASE WHEN pk % 41 = 0 THEN 'list' WHEN pk % 43 = 0 THEN 'yaml' WHEN pk % 37 = 0 THEN 'noid' ELSE 'ok' END AS kind, "
    "'scp.' || cast(pk % 1900 AS string) AS rule_id, CASE pk % 5 WHEN 1 THEN 2 ELSE 1 END AS owners, "
    "CASE pk % 5 WHEN 0 THEN 'src0' WHEN 2 THEN 'src2' WHEN 3 THEN 'src1' WHEN 4 THEN 'src2' END AS owner "
    f"FROM ({v.D_RULE_FILES})"
)
Q["rule_pack_load"] = (
    lambda s, d: _rules(s, d).select(
        "path", "pos", F.coalesce("rule_id", F.lit("")).alias("rule_id"), F.coalesce(F.array_join("languages", ","), F.lit("")).alias("languages"),
        F.coalesce("message", F.lit("")).alias("message"), F.coalesce(F.array_join("cwe", ","), F.lit("")).alias("cwe"),
        F.coalesce(F.array_join("regexes", ","), F.lit("")).alias("regexes"), F.coalesce(F.substring_index("file_error", ":", 1), F.lit("")).alias("file_error"),
    ),
    "SELECT path, CASE WHEN kind IN ('list', 'yaml') THEN -1 ELSE 0 END AS pos, CASE WHEN kind = 'ok' THEN rule_id ELSE '' END AS rule_id, CASE WHEN kind = 'ok' THEN 'python,go' ELSE '' END AS languages, "
    "CASE kind WHEN 'ok' THEN p_name WHEN 'noid' THEN 'no id' ELSE '' END AS message, CASE WHEN kind = 'ok' THEN 'CWE-' || p_size ELSE '' END AS cwe, CASE WHEN kind = 'ok' THEN 'x' || p_size ELSE '' END AS regexes, "
    f"CASE kind WHEN 'list' THEN 'top-level rules must be a list' WHEN 'yaml' THEN 'invalid YAML' ELSE '' END AS file_error FROM ({_F}) JOIN part ON pk = p_partkey",
)


def _languages(spark, sf):
    return corpus.language_inventory(v.files(spark, sf))


_SELECTED = (
    "SELECT project, f.path, CASE WHEN f.path LIKE 'common/%' THEN 0 WHEN f.path LIKE 'vendor/%' THEN 1 + len(langs) ELSE list_position(langs, string_split(f.path, '/')[1]) END AS group_ord, "
    "CASE WHEN f.path LIKE '%.yaml' THEN 0 ELSE 1 END AS ext_ord "
    f"FROM (SELECT project, string_split(languages, ',') AS langs FROM ({_D_LANG_TEXT})) CROSS JOIN ({v.D_RULE_FILES}) f "
    "WHERE f.path LIKE 'common/%' OR f.path LIKE 'vendor/%' OR list_contains(langs, string_split(f.path, '/')[1])"
)
Q["rule_pack_select"] = (lambda s, d: rulepack.rule_pack_select(_docs(s, d), _languages(s, d)), _SELECTED)


def distinct_rule_files(spark, sf):
    """Files listed by every rule of the same brand: many listings, one row per path."""
    listed = v.load(spark, sf, "part").selectExpr("p_brand AS path", "p_partkey AS ord")
    return rulepack.distinct_rule_files(listed, [], ["ord"])


Q["distinct_rule_files"] = (distinct_rule_files, "SELECT p_brand AS path, min(p_partkey) AS ord FROM part GROUP BY p_brand")
Q["rule_owner_match"] = (
    lambda s, d: g.rule_owner_match(_docs(s, d), _good(s, d)).select("path", "owners", F.coalesce("owner", F.lit("")).alias("owner")),
    f"SELECT path, owners, coalesce(owner, '') AS owner FROM ({_F})",
)
_COUNTED = f"SELECT owner AS id, count(*) AS rules FROM ({_F}) WHERE kind = 'ok' AND owners = 1 GROUP BY owner"


def _counts(spark, sf):
    return g.rule_counts(_rules(spark, sf), g.rule_owner_match(_docs(spark, sf), _good(spark, sf)))


Q["rule_counts"] = (_counts, _COUNTED)
_EXPECTED = "SELECT * FROM (VALUES ('src0', 10), ('src1', 0), ('src2', 7), ('src4', 10)) e(id, expected_rule_count)"
Q["rule_count_reconcile"] = (
    lambda s, d: g.rule_count_reconcile(_good(s, d), _counts(s, d)),
    f"SELECT e.id, expected_rule_count, coalesce(rules, 0) AS found, coalesce(rules, 0) = expected_rule_count AS matches FROM ({_EXPECTED}) e LEFT JOIN ({_COUNTED}) c ON e.id = c.id",
)
_HASHES = (
    "SELECT 'src0' AS id, h.path, CASE WHEN f.content IS NULL THEN 'unreadable' WHEN f.content = 'rules: nothing' || chr(10) THEN 'ok' ELSE 'mismatch' END AS status "
    f"FROM (SELECT unnest(['common/r0.yaml', 'common/r10.yaml', 'common/none.yaml']) AS path) h LEFT JOIN ({v.D_RULE_FILES}) f ON h.path = f.path"
)
Q["rule_hash_verify"] = (lambda s, d: g.rule_hash_verify(_good(s, d), _docs(s, d)), _HASHES)
_DUPES = (
    "SELECT rule_id, first_path, path, 0 AS pos FROM (SELECT *, first_value(path) OVER (PARTITION BY rule_id ORDER BY path) AS first_path, row_number() OVER (PARTITION BY rule_id ORDER BY path) AS rn "
    f"FROM ({_F}) WHERE kind = 'ok' {{w}}) WHERE rn > 1"
)
Q["duplicate_rule_ids"] = (lambda s, d: g.duplicate_rule_ids(_parsed(s, d)), _DUPES.format(w=""))
Q["duplicate_source_ids"] = (
    lambda s, d: g.duplicate_source_ids(_sources(s, d)),
    "SELECT 'src' || r_regionkey AS id, 1 AS pos FROM region WHERE r_regionkey = 2",
)
Q["rule_metadata_check"] = (
    lambda s, d: g.rule_metadata_check(_rules(s, d)).select("path", "rule_id", "field"),
    f"WITH f AS ({_F}), r AS (SELECT * FROM f WHERE kind = 'ok') SELECT path, rule_id, 'license' AS field FROM r WHERE pk % 3 <> 0 UNION ALL SELECT path, rule_id, 'confidence' FROM r WHERE pk % 4 <> 0 "
    "UNION ALL SELECT path, rule_id, unnest(['owasp', 'references', 'remediation']) FROM r",
)
Q["rule_governance"] = (
    lambda s, d: g.rule_governance(materialise(_sources(s, d), "sources"), _parsed(s, d), _docs(s, d)).select("check", "subject"),
    f"WITH f AS ({_F}) "
    "SELECT 'manifest' AS check, 'manifest' AS subject UNION ALL SELECT 'source_fields', 'src4' UNION ALL SELECT 'source_id', 'src2' "
    "UNION ALL SELECT 'owner', path FROM f WHERE owners <> 1 UNION ALL SELECT 'file', path FROM f WHERE owners = 1 AND kind IN ('list', 'yaml') "
    f"UNION ALL SELECT 'rule_id', path FROM f WHERE owners = 1 AND kind = 'noid' UNION ALL SELECT 'duplicate', rule_id FROM ({_DUPES.format(w='AND owners = 1')}) "
    f"UNION ALL SELECT 'count', e.id FROM ({_EXPECTED}) e LEFT JOIN ({_COUNTED}) c ON e.id = c.id WHERE coalesce(rules, 0) <> expected_rule_count "
    f"UNION ALL SELECT 'hash', path FROM ({_HASHES}) WHERE status <> 'ok'",
)
