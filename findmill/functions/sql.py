"""Expression functions for SQL users, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from findmill import constants as K
from findmill.functions.text import credential_regexes


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strip(x: str) -> str:
    left = f"regexp_replace({x}, {_lit('(?U)' + chr(92) + 'A' + K.SPACE_CLASS + '+')}, '')"
    return f"regexp_replace({left}, {_lit('(?U)' + K.SPACE_CLASS + '+' + chr(92) + 'z')}, '')"


def _redact(x: str) -> str:
    for rx in credential_regexes().values():
        x = f"regexp_replace({x}, {_lit(rx)}, {_lit(K.REDACTED)})"
    return x


def _relativize() -> str:
    dots = _lit("(?:^|/)" + chr(92) + ".{0,2}(?:/|$)")
    fold = (
        "concat('/', array_join(aggregate(split(if(startswith(p, '/'), p, concat(r, '/', p)), '/'), cast(array() AS array<string>), (acc, x) -> "
        "CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
        "ELSE concat(acc, array(x)) END), '/'))"
    )
    return (
        f"CASE WHEN coalesce(p, '') = '' THEN '' WHEN NOT p RLIKE {dots} THEN p "
        f"WHEN startswith(p, concat(r, '/')) AND NOT substring(p, length(r) + 2) RLIKE {dots} THEN substring(p, length(r) + 2) "
        f"ELSE transform(array({fold}), f -> CASE WHEN f = r THEN '.' WHEN startswith(f, concat(r, '/')) THEN substring(f, length(r) + 2) ELSE '' END)[0] END"
    )


def sql_functions() -> dict[str, str]:
    """Name -> CREATE statement."""
    synonyms = ", ".join(f"'{k}', '{v}'" for k, v in K.SEVERITY_SYNONYMS.items())
    given, snippet = _strip("coalesce(x, '')"), _strip("coalesce(snippet, '')")
    tokens = (
        f"aggregate(coalesce(tokens, cast(array() AS array<string>)), x, (acc, t) -> if(length(t) >= {K.MIN_TOKEN_LENGTH}, "
        f"replace(acc, t, {_lit(K.REDACTED)}), acc))"
    )
    kind = "regexp_extract(schema_of_variant(v), '^([A-Z]+)', 1)"
    cwe = (
        f"CASE WHEN v IS NULL OR {kind} = 'VOID' THEN '' WHEN {kind} = 'OBJECT' THEN coalesce(nullif(try_variant_get(v, '$.id', 'string'), ''), "
        f"try_variant_get(v, '$.name', 'string'), '') WHEN {kind} = 'ARRAY' THEN coalesce(try_variant_get(v, '$[0]', 'string'), '') "
        "ELSE coalesce(try_variant_get(v, '$', 'string'), '') END"
    )
    up = f"upper({_strip(cwe)})"
    bodies = {
        "sev_normalize(x STRING) RETURNS STRING": (
            f"coalesce(try_element_at(map({synonyms}), lower({given})), '{K.DEFAULT_SEVERITY}')"
        ),
        "redact(x STRING, tokens ARRAY<STRING>) RETURNS STRING": _redact(tokens),
        "fingerprint(tool STRING, rule STRING, path STRING, line INT, snippet STRING) RETURNS STRING": (
            "sha2(concat_ws('|', coalesce(tool, ''), coalesce(rule, ''), coalesce(path, ''), coalesce(cast(line AS string), 'N/A'), "
            f"substring({snippet}, 1, {K.FINGERPRINT_SNIPPET_CHARS})), 256)"
        ),
        "cwe_normalize(v VARIANT) RETURNS STRING": (
            f"CASE WHEN {cwe} = '' THEN '' WHEN startswith({up}, 'CWE-') THEN {up} ELSE concat('CWE-', {up}) END"
        ),
        "path_relativize(p STRING, r STRING) RETURNS STRING": _relativize(),
    }
    return {
        head.split("(")[0]: f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}" for head, body in bodies.items()
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Define the functions in this session and return their names."""
    statements = sql_functions()
    for stmt in statements.values():
        spark.sql(stmt)
    return list(statements)
