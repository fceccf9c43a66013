"""Personal data by pattern and by context (bootstrapped extraction), in DataFrame functions only.

1. Seeds: e-mail addresses, IP addresses, card and phone numbers found by fixed patterns in every text.
2. The two words before a seed are a lexical pattern for its kind; the text's beginning and what itself looks like
   an identifier count as words. Tokens with an @ or at least six digits, and short groups of digits with one space
   between that have six in all, are candidates if no seed covers them, with the two words before them.
3. Patterns and instances form a graph. In each round a pattern's confidence is the share of known instances
   among all it extracts; an instance's score combines the patterns that extract it; instances above the bound
   are known from then on and support further patterns, until no round adds any.
4. Candidates that a trusted pattern extracts with a high score are reported as further spans.

What a pattern extracts is counted by pattern and by (pattern, instance), never joined by pattern alone; where
patterns meet all their instances, and instances all their patterns, the join is salted. So a pattern or a number that
a third of all rows share is spread over tasks. Places within a text come from running sums over pieces of 64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import materialise

# The kinds in the order in which they are listed and their patterns. Quantifiers are possessive
# and start only where a run starts (or where the last match ended), which gives the same matches in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_SPACES = "\t\n\u000b\f\r"
_WORD = r"[^\x20\x09-\x0D]"
_GROUP = r"(?:[().+/-]*+[0-9]){1,5}+[().+/-]*+"
_MORE = rf"\x20{_GROUP}(?!{_WORD})"
_LAST = rf"\x20{_GROUP}[,;:!?]++(?!{_WORD})"
_GROUPS = rf"{_GROUP}(?!{_WORD})(?:(?:{_MORE})++(?:{_LAST})?+|{_LAST})"
_CANDIDATE = rf"(?<!{_WORD})(?:{_GROUPS}|(?:[^\x20\x09-\x0D0-9]*+[0-9]){{6}}{_WORD}*+|[^\x20\x09-\x0D@]*+@{_WORD}*+)"
#: Stand in a context for the beginning of the text and for a word that looks like an identifier.
_BEGIN, _VALUE = "<begin>", "<value>"

#: Least number of different known instances of a pattern, least confidence of a pattern, least score.
SUPPORT, CONFIDENCE, SCORE = 3, 0.75, 0.75
#: Tasks that share a pattern's or an instance's rows; values of which a running sum copies at most so many.
SALT, CHUNK = 16, 64

SPAN = "struct<kind: string, start: bigint, end: bigint, value: string, context: string>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, zero: Column, step) -> Column:
    """``zero`` and the running result of ``step`` after each value, in chunks so that long lists are not copied often."""

    def inside(chunk):
        return F.aggregate(chunk, F.array(zero), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def spread(parts):
        sums = F.transform(parts, lambda p: F.element_at(p, -1))
        before = F.aggregate(sums, F.array(zero), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        pairs = F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda v: step(b, v)))
        return F.concat(F.array(zero), F.flatten(pairs))

    def whole(v):
        begins = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(CHUNK))
        return _let(F.transform(begins, lambda i: inside(F.slice(v, i, F.lit(CHUNK)))), spread)

    return _let(values, whole)


def _last_words(piece: Column) -> Column:
    """Up to two words of what stands before a match, the last first, in lower case; identifiers as one mark."""
    back = rf"^[\x20\x09-\x0D]*+({_WORD}++)(?:[\x20\x09-\x0D]++({_WORD}++))?"

    def plain(w):
        odd = F.contains(w, F.lit("@")) | (F.length(_digits(w)) >= 6)
        return F.when(odd, F.lit(_VALUE)).otherwise(F.lower(F.reverse(w)))

    def both(r):
        return F.transform(F.filter(F.array(F.regexp_extract(r, back, 1), F.regexp_extract(r, back, 2)), lambda w: w != ""), plain)

    return _let(F.reverse(piece), both)


def _located(kind: Column, matches: Column, pieces: Column) -> Column:
    """Spans of ``matches``; ``pieces`` is the text between them.

    The words before a match go on across the match before it, which counts as one word.
    """
    pairs = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.struct(
        m.alias("m"), F.length(m).cast("bigint").alias("n"), F.length(p).cast("bigint").alias("gap"), _last_words(p).alias("words")))

    def context(z, i):
        across = F.concat(z[i]["words"], F.when(i == 0, F.array(F.lit(_BEGIN), F.lit(_BEGIN))).otherwise(
            F.concat(F.array(F.lit(_VALUE)), F.slice(F.get(z, i - 1)["words"], 1, 1), F.array(F.when(i == 1, F.lit(_BEGIN)).otherwise(F.lit(_VALUE))))))
        return _let(across, lambda w: F.concat_ws(" ", F.element_at(w, 2), F.element_at(w, 1)))

    def spans(z):
        ends = _running(F.transform(z, lambda x: x["gap"] + x["n"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return _let(ends, lambda e: F.transform(z, lambda x, i: F.struct(
            kind.alias("kind"), (e[i] + x["gap"]).alias("start"), e[i + 1].alias("end"), x["m"].alias("value"), context(z, i).alias("context"))))

    return _let(pairs, spans)


def _uncovered(base: Column, tokens: Column) -> Column:
    """The tokens that overlap no base span: by start, no span before one ends behind its start, none after it starts before its end."""
    far = F.lit(1 << 62).cast("bigint")
    rows = F.concat(F.transform(base, lambda s: _event(s, True)), F.transform(tokens, lambda s: _event(s, False)))

    def free(v):
        latest = _running(F.transform(v, lambda x: F.when(x["known"], x["end"]).otherwise(F.lit(-1).cast("bigint"))), F.lit(-1).cast("bigint"), F.greatest)
        nearest = F.reverse(_running(F.transform(F.reverse(v), lambda x: F.when(x["known"], x["start"]).otherwise(far)), far, F.least))
        ok = _let(latest, lambda a: _let(nearest, lambda b: F.transform(v, lambda x, i: F.struct(
            (~x["known"] & (a[i] <= x["start"]) & (b[i + 1] >= x["end"])).alias("free"), x["span"].alias("span")))))
        return F.transform(F.filter(ok, lambda x: x["free"]), lambda x: x["span"])

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(_let(F.array_sort(rows), free))


def _event(s: Column, known: bool) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(known).alias("known"), s.alias("span"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(13, 19) & _luhn(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def find_personal(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, base (spans found by pattern) and more (spans found by context) of every row of ``docs``.

    A span has kind, start, end (code points, end exclusive), value and context; both lists are ordered by kind as
    listed, then start. A null or empty text has none. Repeated rows each get their own; no rows give no rows;
    other columns are ignored. Each text is read once, in time linear in its length and its matches. Candidates whose
    trusted patterns are of several kinds are a span of each.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(column), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    none = F.expr("cast(array() as array<string>)")
    found = rows.select("*", *[
        F.when(F.contains("text", F.lit(_HINT[k])), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in PATTERNS.items()
    ], F.regexp_extract_all("text", F.lit(_CANDIDATE), F.lit(0)).alias("m_token"))
    no_spans = F.expr(f"cast(array() as array<{SPAN}>)")
    patterns = PATTERNS | {"token": _CANDIDATE}

    def spans(kind: str) -> Column:
        located = _located(F.lit(kind), F.col(f"m_{kind}"), F.split("text", patterns[kind], -1))
        return F.when(F.size(f"m_{kind}") > 0, located).otherwise(no_spans)

    located = found.select("doc_id", "row", *[spans(k).alias(f"s_{k}") for k in patterns])
    base = F.concat(*[F.filter(f"s_{k}", _keeps(k)) for k in KINDS])
    with_base = located.select("doc_id", "row", base.alias("base"), "s_token")
    free = F.filter(_uncovered(F.col("base"), F.col("s_token")), lambda t: F.contains(t["value"], F.lit("@")) | (F.length(_digits(t["value"])) >= 6))
    # spans and candidates only; the written rows carry the row number, which is drawn once
    table = materialise(with_base.select("doc_id", "row", "base", F.transform(free, _trimmed).alias("tokens")), "personal-spans")
    more = _bootstrapped(table)
    rank = F.transform("more", lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("r"), s["start"].alias("start"), s.alias("s")))
    ordered = F.transform(F.array_sort(rank), lambda x: x["s"])
    return table.join(more, "row", "left").select("doc_id", "base", F.coalesce(ordered, no_spans).alias("more"))


def _keeps(kind: str):
    return lambda s: _valid(kind, s["value"])


def _trimmed(t: Column) -> Column:
    """A candidate without the punctuation around it."""
    core = F.regexp_extract(t["value"], r"^[^\p{L}\p{N}]*+(.*?)[^\p{L}\p{N}]*+$", 1)
    lead = F.length(t["value"]) - F.length(F.regexp_replace(t["value"], r"^[^\p{L}\p{N}]+", ""))
    start = t["start"] + lead
    return F.struct(t["kind"].alias("kind"), start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"), t["context"].alias("context"))


def _met(many: DataFrame, few: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """Inner join in which each row of ``few`` may meet any share of ``many``: ``spread`` deals those over tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    return many.withColumn("salt", F.pmod(F.hash(spread), F.lit(SALT))).join(few.withColumn("salt", salts), [*on, "salt"]).drop("salt")


def _bootstrapped(table: DataFrame) -> DataFrame:
    """(row, more): spans of candidates that trusted patterns extract."""
    known = materialise(table.select(F.inline("base")).select("kind", "context", "value").distinct(), "personal-known")
    tokens = table.select("row", F.inline("tokens")).filter("value <> ''")
    instances = materialise(tokens.select("context", "value").distinct(), "personal-instances")
    extracted = materialise(instances.groupBy("context").agg(F.count("*").alias("n")), "personal-extracted")
    size, before = known.count(), -1
    while True:
        support = known.groupBy("kind", "context").agg(F.count("*").alias("pos")).filter(F.col("pos") >= SUPPORT)
        # what else the pattern extracts; an instance known by now counts for it, not against it
        have = known.join(instances, ["context", "value"]).groupBy("kind", "context").agg(F.count("*").alias("have"))
        against = F.coalesce("n", F.lit(0)) - F.coalesce("have", F.lit(0))
        rated = support.join(extracted, "context", "left").join(have, ["kind", "context"], "left")
        trusted = rated.select("kind", "context", (F.col("pos") / (F.col("pos") + against)).alias("confidence"))
        trusted = materialise(trusted.filter(F.col("confidence") >= CONFIDENCE), "personal-patterns")
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(0.99))))
        scored = _met(instances, trusted, ["context"], F.col("value")).groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("score"))
        scored = materialise(scored.filter(F.col("score") >= SCORE), "personal-scored")
        if size == before:
            break
        grown = _met(instances, scored, ["value"], F.col("context")).select("kind", "context", "value")
        known = materialise(known.union(grown).distinct(), "personal-known")
        size, before = known.count(), size
    by_pattern = _met(tokens.drop("kind"), trusted.select("kind", "context"), ["context"], F.col("row"))
    found = _met(by_pattern, scored.select("kind", "value"), ["kind", "value"], F.col("row"))
    # a candidate that patterns of several kinds extract is reported for each
    span = F.struct("kind", "start", "end", "value", "context")
    return found.groupBy("row").agg(F.collect_set(span).alias("more"))


def all_spans() -> Column:
    """base and more together, by kind as listed, then start."""
    of_kind = [F.array_sort(F.filter(F.concat("base", "more"), _of(k)), _by_start) for k in KINDS]
    return F.concat(*of_kind)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] < b["end"], -1).when(a["end"] > b["end"], 1).otherwise(0)
