"""Severity, weakness id, rule id, path and snippet expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from findmill import constants as K
from findmill.functions.text import col, first_text, let, split_lines, strip, text_or_empty


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def sev_normalize(c: Column | str) -> Column:
    """Usual spellings are looked up as they are; others are trimmed and lower-cased first, which costs far more."""
    word = text_or_empty(c)
    usual = {form: s for key, s in K.SEVERITY_SYNONYMS.items() for form in (key, key.upper(), key.capitalize())}
    usual.setdefault("", K.DEFAULT_SEVERITY)
    found = F.try_element_at(literal_map(K.SEVERITY_SYNONYMS), F.lower(strip(word)))
    return F.coalesce(F.try_element_at(literal_map(usual), word), found, F.lit(K.DEFAULT_SEVERITY))


def sev_rank(c: Column | str) -> Column:
    return F.try_element_at(literal_map(K.SEVERITY_RANK), col(c))


def sev_display(c: Column | str) -> Column:
    return F.when(col(c).isin(*K.SEVERITIES), col(c)).otherwise("info")


def zap_severity(c: Column | str) -> Column:
    return F.coalesce(F.try_element_at(literal_map(K.ZAP_RISK_SEVERITY), col(c).cast("int")), F.lit("info"))


def _variant_kind(v: Column) -> Column:
    """Outermost type of a variant: the part of its schema before any ``<`` or ``(``."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def _scalar_text(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))


def _first_of_list(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.lit(""))


def cwe_normalize(c: Column | str) -> Column:
    """Weakness id from a variant holding a string, number, list or object."""
    v = col(c)
    kind = _variant_kind(v)
    picked = (
        F.when(v.isNull() | (kind == "VOID"), F.lit(""))
        .when(
            kind == "OBJECT",
            first_text(F.try_variant_get(v, "$.id", "string"), F.try_variant_get(v, "$.name", "string")),
        )
        .when(kind == "ARRAY", _first_of_list(v))
        .otherwise(_scalar_text(v))
    )
    return cwe_from_text(picked)


def cwe_from_text(c: Column | str) -> Column:
    raw = text_or_empty(c)
    up = F.upper(strip(raw))
    return F.when(raw == "", "").when(up.startswith("CWE-"), up).otherwise(F.concat(F.lit("CWE-"), up))


def rule_id_clean(c: Column | str) -> Column:
    s = text_or_empty(c)
    at = F.locate("scp.", s)
    return F.when(at > 0, F.substring(s, at, F.length(s))).otherwise(s)


def snippet_marked_lines(c: Column | str) -> Column:
    """Lines an engine printed with a number in front, without the number."""
    bare = F.transform(split_lines(text_or_empty(c)), lambda x: F.regexp_replace(x, r"\A[0-9]+", ""))
    kept = F.filter(bare, lambda x: x.startswith(">>>") | x.startswith("   "))
    return F.substring(F.array_join(F.transform(kept, strip), "\n"), 1, K.SNIPPET_CHARS)


def engine_snippet(c: Column | str) -> Column:
    """Snippet the engine delivered itself; null when the source has to be read."""
    t = strip(text_or_empty(c))
    lines = F.slice(split_lines(text_or_empty(c)), 1, K.SNIPPET_LINES)
    return F.when((t != "") & (t != "requires login"), F.substring(F.array_join(lines, "\n"), 1, K.SNIPPET_CHARS))


def path_relativize(c: Column | str, root: Column | str) -> Column:
    """Path below ``root`` (an absolute directory); '' when it lies outside.

    Clean paths take two string tests; only paths with empty or dot segments are folded.
    """
    p = text_or_empty(c)
    r = F.lit(root.rstrip("/")) if isinstance(root, str) else F.regexp_replace(root, "/+$", "")
    clean = ~p.rlike(r"(?:^|/)\.{0,2}(?:/|$)")
    under = p.startswith(F.concat(r, F.lit("/")))
    below = F.substring(p, F.length(r) + 2, F.length(p))
    full = F.when(p.startswith("/"), p).otherwise(F.concat(r, F.lit("/"), p))
    stack = F.aggregate(
        F.split(full, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
    )
    folded = F.concat(F.lit("/"), F.array_join(stack, "/"))
    located = let(
        folded,
        lambda f: F.when(f == r, ".")
        .when(f.startswith(F.concat(r, F.lit("/"))), F.substring(f, F.length(r) + 2, F.length(f)))
        .otherwise(""),
    )
    return (
        F.when(p == "", "")
        .when(clean, p)
        .when(under & ~below.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), below)
        .otherwise(located)
    )


def path_contained(c: Column | str, root: Column | str) -> Column:
    return path_relativize(c, root) != ""


def base_name(c: Column | str) -> Column:
    return F.substring_index(col(c), "/", -1)


def path_suffix(c: Column | str) -> Column:
    """Lower-cased last suffix of the file name; a leading dot does not start a suffix."""
    return F.lower(F.regexp_extract(base_name(c), r"^\.*[^.].*?(\.[^.]+)$", 1))


def trivy_remediation(pkg: Column, installed: Column, fixed: Column, references: Column) -> Column:
    ref = F.get(references, 0)
    return F.concat(
        F.lit("Upgrade "),
        text_or_empty(pkg),
        F.lit(" from "),
        text_or_empty(installed),
        F.when(text_or_empty(fixed) != "", F.concat(F.lit(" to "), fixed)).otherwise(""),
        F.when(ref.isNotNull(), F.concat(F.lit(". See: "), ref)).otherwise(""),
    )


def member_type(filename: Column | str, external_attr: Column | str) -> Column:
    """Kind of a ZIP member from its Unix mode bits."""
    mode = F.shiftright(col(external_attr).cast("long"), 16).bitwiseAND(F.lit(0o170000))
    return (
        F.when(col(filename).endswith("/") | (mode == 0o040000), "dir")
        .when(mode == 0o120000, "symlink")
        .when(mode.isin(0o100000, 0), "file")
        .otherwise("special")
    )


def finding_header(severity: Column, tool: Column, rule: Column, cwe: Column) -> Column:
    return F.concat_ws(" | ", F.upper(col(severity)), col(tool), col(rule), F.nullif(col(cwe), F.lit("")))


def finding_location(path: Column, line: Column) -> Column:
    where = F.coalesce(F.nullif(col(path), F.lit("")), F.lit("-"))
    shown = F.coalesce(col(line), F.lit(0)) != 0
    return F.when(shown, F.concat(where, F.lit(":"), col(line).cast("string"))).otherwise(where)
