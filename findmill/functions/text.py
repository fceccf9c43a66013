"""String cleaning, redaction, hashing and display formatting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from findmill import constants as K

# Unicode character classes make Java agree with Python on \b, \s and \w.
_JAVA_PATTERNS = {name: "(?U)" + rx for name, rx in K.CREDENTIAL_PATTERNS.items()}
# Literal text every match of a pattern holds, to skip most texts with a plain byte search.
_ANCHORS = {
    "aws-access-key": "AKIA",
    "live-secret-key": "sk_live_",
    "live-public-key": "pk_live_",
    "private-key": "PRIVATE KEY-----",
}
# The part of an assignment from its sign on: starts at two characters only, so it scans fast.
_ASSIGNED_TAIL = r"(?iU)[:=]\s*[\"']?[A-Za-z0-9_\-./+=]{8,}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, where Catalyst would compute it per use."""
    return F.get(F.transform(F.array(value), body), 0)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def first_text(*cs: Column | str) -> Column:
    """First value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space; Spark's own trim removes spaces only."""
    return F.btrim(col(c), F.lit(K.SPACES))


def split_lines(c: Column | str) -> Column:
    """Lines of a text under the full set of line separators; no trailing empty line."""
    body = F.regexp_replace(col(c), rf"(?:{K.LINE_BREAK})\z", "")
    return F.when(col(c) == "", F.expr("cast(array() AS array<string>)")).otherwise(F.split(body, K.LINE_BREAK))


def has_credential(c: Column | str) -> Column:
    """Whether some credential pattern occurs; cheap necessary conditions come first."""
    out = F.lit(False)
    for name, rx in _JAVA_PATTERNS.items():
        may = col(c).contains(_ANCHORS[name]) if name in _ANCHORS else col(c).rlike(_ASSIGNED_TAIL)
        out = out | (may & col(c).rlike(rx))
    return out


def credential_regexes() -> dict[str, str]:
    return dict(_JAVA_PATTERNS)


def redact_patterns(c: Column | str) -> Column:
    """Replace credential-looking text. One test decides whether the five passes run."""
    chain = reduce(
        lambda acc, rx: F.regexp_replace(acc, rx, F.lit(K.REDACTED)), _JAVA_PATTERNS.values(), col(c)
    )
    return F.when(has_credential(c), chain).otherwise(col(c))


def redact_tokens(c: Column | str, tokens: Column | str) -> Column:
    """Replace exact tokens that are long enough to be meaningful."""
    cut = F.aggregate(
        col(tokens),
        col(c),
        lambda acc, tok: F.when(
            F.length(tok) >= K.MIN_TOKEN_LENGTH, F.replace(acc, tok, F.lit(K.REDACTED))
        ).otherwise(acc),
    )
    return F.when(F.size(F.coalesce(col(tokens), F.array().cast("array<string>"))) > 0, cut).otherwise(col(c))


def redact(c: Column | str, tokens: Column | str | None = None) -> Column:
    return redact_patterns(c if tokens is None else redact_tokens(c, tokens))


def redact_match(match: Column | str, secret: Column | str) -> Column:
    """Mask first and cut afterwards, so a secret on the cut cannot survive in part."""
    m, s = text_or_empty(match), text_or_empty(secret)
    return F.substring(F.when(s != "", F.replace(m, s, F.lit(K.REDACTED))).otherwise(m), 1, 200)


def redact_url_creds(c: Column | str, token: Column | str | None = None) -> Column:
    out = col(c)
    if token is not None:
        t = text_or_empty(token)
        out = F.when(t != "", F.replace(out, t, F.lit(K.REDACTED))).otherwise(out)
    return F.regexp_replace(out, r"(?U)x-token-auth:[^@\s]+@", K.REDACTED + "@")


def sanitize_reason(c: Column | str, *prefixes: Column | str) -> Column:
    out = col(c)
    for p in prefixes:
        p = F.lit(p) if isinstance(p, str) else p
        out = F.when(p != "", F.replace(out, p, F.lit("<workdir>"))).otherwise(out)
    return out


def mask_credentials(c: Column | str) -> Column:
    return F.when(F.length(col(c)) > 0, "***").otherwise("")


def fingerprint(
    tool: Column | str, rule: Column | str, path: Column | str, line: Column | str, snippet: Column | str
) -> Column:
    """SHA-256 over the identity of a finding."""
    where = F.coalesce(col(line).cast("string"), F.lit("N/A"))
    text = F.substring(strip(text_or_empty(snippet)), 1, K.FINGERPRINT_SNIPPET_CHARS)
    parts = [text_or_empty(tool), text_or_empty(rule), text_or_empty(path), where, text]
    return F.sha2(F.concat_ws("|", *parts), 256)


def slugify(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(c), r"[^a-zA-Z0-9._-]", ""))


def first_int(c: Column | str) -> Column:
    """Tolerant integer parse; anything else is null."""
    return F.when(
        col(c).cast("string").rlike(r"(?U)^\s*[+-]?[0-9]+\s*$"), strip(col(c).cast("string")).try_cast("long")
    )


def parse_bool(c: Column | str) -> Column:
    """Strict boolean as ``struct<value, error>``; blank and null mean false."""
    word = F.lower(strip(text_or_empty(c)))
    value = F.when(word.isin(*K.TRUE_WORDS), True).when((word == "") | word.isin(*K.FALSE_WORDS), False)
    error = F.when(value.isNull(), F.concat(F.lit("invalid boolean value: "), col(c)))
    return F.struct(value.alias("value"), error.alias("error"))


def markup_escape(c: Column | str, quotes: bool = False) -> Column:
    """Escape markup; ``&`` goes first so entities are not escaped twice."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quotes:
        pairs += [('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, text_or_empty(c))


def human_size(c: Column | str) -> Column:
    n = col(c)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0))
        .otherwise(F.format_string("%.1f MB", n / 1024.0 / 1024.0))
    )


def is_commit_sha(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"\A[0-9a-f]{40}\z"), F.lit(False))


def format_timestamp(c: Column | str) -> Column:
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd HH:mm 'UTC'"), F.lit("-"))


def is_rate_limited(c: Column | str) -> Column:
    t = F.lower(text_or_empty(c))
    return t.contains("maven") & (t.contains("returned 429") | t.contains("429 too many requests"))


def retry_after(c: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(c), r"(?i)Retry-After:\s*(\d+)", 1)


def sse_format(event_type: Column | str, data: Column | str) -> Column:
    """One server-sent-event frame; ``data`` is JSON text."""
    return F.concat(F.lit("event: "), col(event_type), F.lit("\ndata: "), col(data), F.lit("\n\n"))


def contains_like(c: Column | str, needle: str) -> Column:
    """Case-insensitive LIKE where % and _ of the needle stay wildcards."""
    pattern = F.lower(F.lit(f"%{needle}%"))
    return F.like(F.lower(col(c)), pattern, F.lit("\u0001"))
