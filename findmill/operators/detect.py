"""Pattern detection over a corpus: credentials, regex rules, call-shaped rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill import schemas as S
from findmill.functions.findings import sev_normalize
from findmill.functions.text import credential_regexes, has_credential, redact_patterns
from findmill.sources.corpus import language_of, source_lines

GENERIC = "generic"
_MARK = "\u0001"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    languages: tuple[str, ...]
    severity: str
    message: str = ""
    cwe: str = ""
    category: str = ""
    regexes: tuple[str, ...] = field(default=())


def _raw_finding(df: DataFrame, keep: list[str], **cols: Column) -> DataFrame:
    out = []
    for f in S.RAW_FINDING.fields:
        if f.name in cols:
            c = cols[f.name]
        elif f.name == "redaction_tokens":
            c = F.array()
        elif f.dataType.simpleString() == "string":
            c = F.lit("")
        else:
            c = F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*keep, *out)


def secret_scan(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Credential patterns on every line, one row per match.

    Whole texts are tested first; only the few that can match are split into lines.
    ``keep`` columns (the file identity) are carried; ``ordinal`` numbers matches in a line.
    """
    keep = keep or ["project", "path"]
    lines = source_lines(files.where(has_credential("content")).select(*keep, "content"))
    lines = lines.where(has_credential("text"))

    def matches(name: str, rx: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(rx), F.lit(0))
        return F.transform(found, lambda m: F.struct(F.lit(name).alias("name"), m.alias("match")))

    hits = F.flatten(F.array(*[matches(name, rx) for name, rx in credential_regexes().items()]))
    rows = lines.select(*keep, "line", "text", F.posexplode(hits).alias("ordinal", "h"))
    return _raw_finding(
        rows,
        [*[k for k in keep if k != "path"], "ordinal"],
        tool=F.lit("credential-patterns"),
        source_type=F.lit("secrets"),
        rule_id=F.concat(F.lit("secret."), F.col("h.name")),
        severity=F.lit("high"),
        file_path=F.col("path") if "path" in keep else F.lit(""),
        line_start=F.col("line"),
        line_end=F.col("line"),
        snippet=redact_patterns("text"),
        redaction_tokens=F.array(F.col("h.match")),
    )


def _rule_hits(rules: Iterable[Rule], text: Column, test: Callable[[Column, str], Column], lang: Column) -> Column:
    """Array of the rules that match; every pattern is a literal, so it is compiled once."""
    hits = []
    for i, rule in enumerate(rules):
        fits = F.lit(True) if GENERIC in rule.languages else lang.isin(*rule.languages)
        found = [test(text, rx) for rx in rule.regexes]
        matched = found[0]
        for more in found[1:]:
            matched = matched | more
        hits.append(F.when(fits & matched, F.lit(i)))
    return F.array_compact(F.array(*hits))


def _rule_table(rules: list[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                sev_normalize(F.lit(r.severity)).alias("severity"),
                F.lit(r.message).alias("message"),
                F.lit(r.cwe).alias("cwe"),
                F.lit(r.category).alias("category"),
            )
            for r in rules
        ]
    )


def _as_findings(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    r = F.get(_rule_table(rules), F.col("hit"))
    base = r["severity"]
    return _raw_finding(
        rows,
        ["project"],
        tool=F.lit("rule-scan"),
        source_type=F.lit("sast"),
        rule_id=r["rule_id"],
        severity=F.when((base == "info") & (r["category"] == "security"), "medium").otherwise(base),
        cwe=r["cwe"],
        file_path=F.col("path"),
        line_start=F.col("line"),
        line_end=F.col("line"),
        snippet=F.substring("text", 1, 2000),
        description=r["message"],
    )


def rule_scan(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Regex rules on whole texts; a rule applies to its languages or, when generic, to all files.

    A match may run over several lines. One finding per rule and line on which a match starts; matches of one
    expression do not overlap, as in a search from the start. ``^`` and ``$`` hold at every line.
    """
    # each expression searches for itself: a long match of one must not hide the start of another's
    single = [replace(r, regexes=(rx,)) for r in rules for rx in r.regexes]
    found = _as_findings(_marked_lines(files, single, lambda rx: f"(?m){rx}", lambda rx: f"(?m){rx}"), single)
    return found if len(single) == len(rules) else found.dropDuplicates(["project", "file_path", "rule_id", "line_start"])


def _marked_lines(files: DataFrame, rules: list[Rule], place: Callable[[str], str], test: Callable[[str], str]) -> DataFrame:
    """(project, path, hit, line, text, marks): lines on which matches of a rule start, and how many.

    A mark is put in front of every match in the whole text; the line that holds a mark is where it starts.
    """
    lang = F.col("lang")
    picked = files.select("project", "path", F.translate("content", _MARK, "").alias("content"), F.coalesce(language_of("path"), F.lit("")).alias("lang"))
    hits = _rule_hits(rules, F.col("content"), lambda t, rx: t.rlike(test(rx)), lang)
    matched = picked.select("project", "path", "content", F.explode(hits).alias("hit"))
    marked = F.coalesce(
        *[
            F.when(F.col("hit") == i, F.regexp_replace("content", "(" + place("|".join(f"(?:{rx})" for rx in rule.regexes)) + ")", _MARK + "$1"))
            for i, rule in enumerate(rules)
        ]
    )
    lines = source_lines(matched.select("project", "path", "hit", marked.alias("content"))).where(F.col("text").contains(_MARK))
    plain = F.translate("text", _MARK, "")
    return lines.select("project", "path", "hit", "line", plain.alias("text"), (F.length("text") - F.length(plain)).alias("marks"))


#: Levels of brackets that the arguments in front of a named one may nest.
_NESTING = 12


def _nested() -> str:
    """Text with balanced brackets; possessive, so that long arguments need no stack."""
    out = r"[^()]*+"
    for _ in range(_NESTING):
        out = rf"[^()]*+(?:\({out}\)[^()]*+)*+"
    return out


def compile_call_pattern(pattern: str) -> str:
    """Regex for a call-shaped pattern: ``...`` is any arguments, ``$NAME`` any expression.

    An approximation without a syntax tree: comments and strings may match, aliases do not.
    """
    tokens = re.findall(r"\.\.\.|\$[A-Z_]+|\"[^\"]*\"|\w+|\s+|[^\w\s]", pattern)
    out: list[str | None] = []
    i = 0
    while i < len(tokens):
        tok = tokens[i]
        if tok == "...":
            # ", ..." around an ellipsis is optional: it may stand for no argument.
            if out and out[-1] == r"\s*,\s*":
                out.pop()
            out.append(None)
            while i + 1 < len(tokens) and (tokens[i + 1] == "," or tokens[i + 1].isspace()):
                i += 1
        elif tok.startswith("$"):
            out.append(r"[^\s,()][^,()]*" if out else r"[\w.\])]+")
        elif tok == ",":
            out.append(r"\s*,\s*")
            while i + 1 < len(tokens) and tokens[i + 1].isspace():
                i += 1
        elif tok == "=":
            out.append(r"\s*=(?!=)\s*")
        elif tok == "(":
            out.append(r"\s*\(\s*")
        elif tok == ")":
            out.append(r"\s*\)")
        elif tok.isspace():
            out.append(r"\s*")
        elif tok == ".":
            out.append(r"\s*\.\s*")
        elif tok.isidentifier():
            out.append(rf"\b{tok}\b")
        else:
            out.append(re.escape(tok))
        i += 1
    # What any arguments at the end hold, and where the call ends, does not matter.
    if out[-2:] == [None, r"\s*\)"]:
        del out[-2:]
    for k in range(len(out) - 1, -1, -1):
        if out[k] is None:
            follow = "".join(out[k + 1:])
            # any arguments up to the place where the rest fits, brackets taken as a whole
            out[k] = rf"(?:(?!{follow})(?:[^()]|\({_nested()}\)))*+"
    head = r"(?<![\w.])" if tokens and tokens[0].isidentifier() else ""
    return head + "".join(out)


def rule_scan_calls(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Call rules that may span lines; one finding per match, on the line where it starts."""
    lines = _marked_lines(files, rules, lambda rx: rx, lambda rx: rx)
    return _as_findings(lines.withColumn("_m", F.explode(F.sequence(F.lit(1), "marks"))), rules)


def rules_from_rows(rows: Iterable, compile_calls: bool) -> list[Rule]:
    """Rules of one kind from loaded pack rows. A pack is configuration, not data."""
    out = []
    for r in rows:
        regexes = tuple(compile_call_pattern(p) for p in (r["patterns"] or [])) if compile_calls else tuple(r["regexes"] or ())
        if r["rule_id"] and regexes and not r["unsupported"]:
            out.append(
                Rule(
                    r["rule_id"],
                    tuple(r["languages"] or ()),
                    r["severity"] or "warning",
                    r["message"] or "",
                    (r["cwe"] or [""])[0],
                    r["category"] or "",
                    regexes,
                )
            )
    return out
