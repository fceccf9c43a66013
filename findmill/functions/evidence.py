"""Evidence document: assembly, extraction of its parts, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findmill import constants as K
from findmill.functions.findings import _variant_kind
from findmill.functions.text import col, first_text, redact, redact_patterns, text_or_empty
from findmill.schemas import EVIDENCE_DDL


def _text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def evidence_confidence(raw: Column | str) -> Column:
    """Confidence of the finding itself first, then of its rule metadata; upper case."""
    v = col(raw)
    return F.upper(
        first_text(_text_at(v, "$.issue_confidence"), _text_at(v, "$.confidence"), _text_at(v, "$.extra.metadata.confidence"))
    )


def evidence_owasp(raw: Column | str) -> Column:
    val = F.try_variant_get(col(raw), "$.extra.metadata.owasp", "variant")
    kind = _variant_kind(val)
    return F.coalesce(
        F.when(kind == "STRING", F.try_variant_get(val, "$", "string")).when(
            kind == "ARRAY", F.try_variant_get(val, "$[0]", "string")
        ),
        F.lit(""),
    )


def evidence_references(raw: Column | str, remediation: Column | str) -> Column:
    """Rule references, then the link of the finding, then a remediation that is a link."""
    v = col(raw)
    val = F.try_variant_get(v, "$.extra.metadata.references", "variant")
    kind = _variant_kind(val)
    none = F.array().cast("array<string>")
    listed = (
        F.when(kind == "ARRAY", F.try_variant_get(val, "$", "array<string>"))
        .when((kind == "STRING") & (F.try_variant_get(val, "$", "string") != ""), F.array(F.try_variant_get(val, "$", "string")))
        .otherwise(none)
    )
    more = F.try_variant_get(v, "$.more_info", "variant")
    more_text = F.when(_variant_kind(more) == "STRING", F.try_variant_get(more, "$", "string"))
    rem = text_or_empty(remediation)
    return F.concat(
        F.coalesce(listed, none),
        F.when(text_or_empty(more_text) != "", F.array(more_text)).otherwise(none),
        F.when(rem.startswith("http"), F.array(rem)).otherwise(none),
    )


def is_secret_finding(source_type: Column | str, rule_id: Column | str) -> Column:
    return (col(source_type) == "secrets") | F.lower(text_or_empty(rule_id)).contains("secret")


def evidence_context_redact(
    context: Column | str, source_type: Column | str, rule_id: Column | str, tokens: Column | str
) -> Column:
    """Redact every context line; exact tokens apply to secret findings only."""

    def rebuild(line: Column, text: Column) -> Column:
        return F.struct(
            line["line"].alias("line"), text.alias("text"), line["vulnerable"].alias("vulnerable")
        )

    exact = F.transform(col(context), lambda x: rebuild(x, redact(x["text"], col(tokens))))
    generic = F.transform(col(context), lambda x: rebuild(x, redact_patterns(x["text"])))
    return F.when(is_secret_finding(source_type, rule_id), exact).otherwise(generic)


def evidence_build(
    *,
    rule_id: Column,
    tool: Column,
    file_path: Column,
    line_start: Column,
    line_end: Column,
    col_start: Column,
    col_end: Column,
    cwe: Column,
    confidence: Column,
    owasp: Column,
    references: Column,
    context: Column,
) -> Column:
    """Version-1 evidence struct; absent parts are null, so ``to_json`` leaves them out."""

    def present(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    located = line_start.isNotNull()
    has_context = located & (text_or_empty(file_path) != "")
    built = F.struct(
        F.lit(K.EVIDENCE_VERSION).alias("version"),
        present(file_path).alias("file"),
        F.when(located, F.struct(line_start.alias("line"), col_start.alias("column"))).alias("start"),
        F.when(
            located, F.struct(F.coalesce(line_end, line_start).alias("line"), col_end.alias("column"))
        ).alias("end"),
        F.when(has_context, context).alias("context"),
        F.struct(rule_id.alias("id"), tool.alias("tool")).alias("rule"),
        present(cwe).alias("cwe"),
        present(confidence).alias("confidence"),
        present(owasp).alias("owasp"),
        F.when(F.size(references) > 0, references).alias("references"),
    )
    return built.cast(EVIDENCE_DDL)


def evidence_parse(c: Column | str) -> Column:
    """Stored text as an object variant; invalid or non-object text gives ``{}``."""
    v = F.try_parse_json(col(c))
    return F.when(_variant_kind(v) == "OBJECT", v).otherwise(F.parse_json(F.lit("{}")))
