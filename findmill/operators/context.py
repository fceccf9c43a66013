"""Source context of findings: surrounding lines and fallback snippets.

Both work on distinct spans (project, path, start, end), so a thousand findings on one
line cost one lookup. A span is expanded to the line numbers it may show and equi-joined
to the numbered lines; that is a band join without a nested loop. One pass over the files
gives both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findmill import constants as K
from findmill.functions.text import split_lines
from findmill.sources.corpus import line_pieces, line_text

_SPAN = ["project", "file_path", "_s", "_e"]


def context_cap(
    rows: DataFrame, span: list[str], order: str, size: Column, max_rows: int, max_bytes: int
) -> DataFrame:
    """Longest prefix of each span within a row count and a byte sum. Spans are small by construction."""
    w = Window.partitionBy(*span).orderBy(order)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_n", F.row_number().over(w))
        .withColumn("_b", running)
        .where((F.col("_n") <= max_rows) & (F.col("_b") <= max_bytes))
        .drop("_n", "_b")
    )


def _spans(findings: DataFrame, read: Column) -> DataFrame:
    """Distinct places; ``_read`` tells whether a finding there wants the source's own lines."""
    known = findings.where(F.col("line_start").isNotNull() & (F.col("file_path") != ""))
    return known.groupBy("project", "file_path", F.col("line_start").alias("_s"), F.coalesce("line_end", "line_start").alias("_e")).agg(F.bool_or(read).alias("_read"))


def _numbers(low: str, high: str) -> Column:
    return F.when(F.col(high) >= F.col(low), F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))


def _marked(kind: int, numbers: Column) -> Column:
    return F.transform(numbers, lambda n: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("line")))


def source_of_spans(
    spans: DataFrame,
    files: DataFrame,
    before: int = K.CONTEXT_BEFORE,
    after: int = K.CONTEXT_AFTER,
    max_lines: int = K.MAX_CONTEXT_LINES,
    max_bytes: int = K.MAX_CONTEXT_BYTES,
    snippet_chars: int = K.SNIPPET_CHARS,
) -> DataFrame:
    """Context and own lines of every span ``(project, file_path, _s, _e, _read)`` that has any, from one pass over the files.

    ``context`` are the lines round the span, bounded in count and bytes; a contiguous prefix comes out, so looking at
    ``max_lines`` numbers is exact. ``read`` are the span's lines (by all line ends, as snippets count them) cut to
    ``snippet_chars``; every line but the last adds a line break at least, so that many lines plus one are exact.
    Both kinds are lines of one exploded array. Files nothing points at stop at the join, other lines at the slice.
    """
    wanted = (
        spans.withColumn("_lo", F.greatest(F.lit(1), F.col("_s") - before))
        .withColumn("_hi", F.least(F.col("_e") + after, F.col("_lo") + max_lines - 1))
        .withColumn("_first", F.when(F.col("_read"), F.greatest(F.lit(1), F.col("_s"))))
        .withColumn("_last", F.least(F.when(F.col("_e") == 0, F.col("_s")).otherwise(F.col("_e")), F.col("_first") + snippet_chars))
    )
    need = wanted.groupBy("project", "file_path").agg(
        *[f(F.when(F.col(high) >= F.col(low), F.col(c))).alias(c) for low, high in (("_lo", "_hi"), ("_first", "_last")) for f, c in ((F.min, low), (F.max, high))]
    )
    held = files.select("project", F.col("path").alias("file_path"), "content").join(need, ["project", "file_path"])

    def lines(kind: int, pieces: Column, low: str, high: str, size, text) -> Column:
        some = F.slice(pieces, F.col(low), F.col(high) - F.col(low) + 1)
        shown = F.transform(some, lambda p, i: F.struct(F.lit(kind).alias("kind"), (F.col(low) + i).cast("int").alias("line"), text(p).alias("text"), size(p).cast("long").alias("size")))
        return F.coalesce(shown, F.expr("cast(array() as array<struct<kind:int,line:int,text:string,size:bigint>>)"))

    def cut(p: Column) -> Column:
        return F.when(F.octet_length(p) > max_bytes, K.LINE_TRUNCATED).otherwise(line_text(p))

    context = lines(0, line_pieces(F.col("content")), "_lo", "_hi", lambda p: F.octet_length(cut(p)) + 1, cut)
    own = lines(1, split_lines("content"), "_first", "_last", lambda p: F.length(F.substring(p, 1, snippet_chars)) + 1, lambda p: F.substring(p, 1, snippet_chars))
    found = held.select("project", "file_path", F.inline(F.concat(context, own)))
    numbered = wanted.select(*_SPAN, F.inline(F.concat(_marked(0, _numbers("_lo", "_hi")), _marked(1, _numbers("_first", "_last")))))
    upto = Window.partitionBy(*_SPAN, "kind").orderBy("line")
    sized = numbered.join(found, ["project", "file_path", "kind", "line"]).select("*", F.row_number().over(upto).alias("_n"), F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"))
    shown = sized.where(((F.col("kind") == 0) & (F.col("_n") <= max_lines) & (F.col("_sum") <= max_bytes)) | ((F.col("kind") == 1) & (F.col("_sum") - F.col("size") < snippet_chars)))
    flagged = F.struct("line", "text", F.col("line").between(F.col("_s"), F.col("_e")).alias("vulnerable"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.struct("line", "text")))), lambda s: s["text"]), "\n")
    return shown.groupBy(*_SPAN).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == 0, flagged))).alias("context"), F.max("kind").alias("_kind"), F.substring(text, 1, snippet_chars).alias("read")
    ).select(*_SPAN, "context", F.when(F.col("_kind") == 1, F.col("read")).alias("read"))


def _attach(findings: DataFrame, per_span: DataFrame, column: str) -> DataFrame:
    keyed = findings.withColumn("_s", F.col("line_start")).withColumn("_e", F.coalesce("line_end", "line_start"))
    return keyed.join(per_span.select(*_SPAN, column), _SPAN, "left").drop("_s", "_e")


def attach_context(findings: DataFrame, per_span: DataFrame) -> DataFrame:
    empty = F.expr("cast(array() as array<struct<line:int,text:string,vulnerable:boolean>>)")
    return _attach(findings, per_span, "context").withColumn("context", F.coalesce("context", empty))


def attach_snippet(findings: DataFrame, per_span: DataFrame) -> DataFrame:
    """Null snippets filled with the source's lines, or blank."""
    return _attach(findings, per_span, "read").withColumn("snippet", F.coalesce("snippet", "read", F.lit(""))).drop("read")


def spans_of(findings: DataFrame) -> DataFrame:
    """Places of findings, and whether a finding there has no snippet."""
    return _spans(findings, F.col("snippet").isNull())


def context_join(
    findings: DataFrame,
    files: DataFrame,
    before: int = K.CONTEXT_BEFORE,
    after: int = K.CONTEXT_AFTER,
    max_lines: int = K.MAX_CONTEXT_LINES,
    max_bytes: int = K.MAX_CONTEXT_BYTES,
) -> DataFrame:
    """Add ``context``: numbered lines round each finding, flagged, bounded in count and bytes.

    ``findings`` needs project, file_path, line_start, line_end; ``files`` project, path, content. With files of
    ``store_sources`` no text is shuffled.
    """
    return attach_context(findings, source_of_spans(_spans(findings, F.lit(False)), files, before, after, max_lines, max_bytes))


def snippet_fallback(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Fill null snippets with the matched source lines, cut to the snippet size."""
    missing = findings.where("snippet is null")
    # no context is wanted: the spans' lines end before they begin
    return attach_snippet(findings, source_of_spans(_spans(missing, F.lit(True)), files, after=-(1 << 30)))


def with_source(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Both at once: ``context``, and null snippets filled."""
    per_span = source_of_spans(spans_of(findings), files)
    keyed = findings.withColumn("_s", F.col("line_start")).withColumn("_e", F.coalesce("line_end", "line_start"))
    empty = F.expr("cast(array() as array<struct<line:int,text:string,vulnerable:boolean>>)")
    joined = keyed.join(per_span, _SPAN, "left").drop("_s", "_e")
    return joined.withColumn("context", F.coalesce("context", empty)).withColumn("snippet", F.coalesce("snippet", "read", F.lit(""))).drop("read")
