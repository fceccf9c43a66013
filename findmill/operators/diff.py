"""Unified diffs -> changed line ranges, and matching findings against them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findmill.functions.findings import base_name
from findmill.functions.text import let, split_lines, strip
from findmill.operators.ordered import Running, chunk_of, with_running

_HUNK = r"\A@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@.*\z"
_HUNK_HEAD = r"@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"
_CHUNK_LINES = 1 << 16
# A diff of up to this many characters is read within its row.
_ROW_CHARS = 1 << 16
# Single characters below 256 are matched by a bit set.
_RARE_BREAKS = r"[\r\x0b\x0c\x1c\x1d\x1e\x85]"
_BUCKET_BITS = 6


def _is_git(l: Column) -> Column:
    return l.startswith("diff --git ") | l.startswith("diff --cc ")


def _file_of(l: Column) -> Column:
    name = F.when(l.startswith("+++ b/"), F.substring(l, 7, 1 << 30)).otherwise(F.substring(l, 5, 1 << 30))
    return strip(F.substring_index(name, "\t", 1))


def _start_of(l: Column) -> Column:
    return F.regexp_extract(l, _HUNK, 1).try_cast("int")


def diff_hunks(diffs: DataFrame, keys: list[str], text: str = "diff_text") -> DataFrame:
    """New-side range of every hunk: ``keys, path, start, end``, not yet merged.

    The lines a hunk adds or keeps are numbered without gaps from its start, so a hunk is a
    start and a count. Line texts are judged where they are split and only the verdicts are
    shuffled; the one sort over lines stays inside a diff, that is inside one input row.
    """
    l = F.col("l")
    git, named = _is_git(l), l.startswith("+++ ")
    old = l.startswith("--- a/") | (l == "--- /dev/null")
    file = F.when(named, _file_of(l))
    head = git | old | named
    hunk = F.when(l.startswith("@@ ") & ~head, _start_of(l))
    judged = (
        diffs.select(*keys, F.posexplode(split_lines(text)).alias("i", "l"))
        .select(*keys, "i", git.alias("git"), file.alias("file"), hunk.alias("hs"), (~head & ~l.rlike(r"\A[\\-]")).alias("body"))
        .withColumn("body", F.col("body") & F.col("hs").isNull())
    )
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)

    def since_git(c: str) -> Column:
        """Latest value of a column in the block; the block's own header clears it."""
        event = F.when(F.col("git"), F.struct(F.lit(None).cast(dict(judged.dtypes)[c]).alias("v"))).when(
            F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))
        )
        return F.last(event, ignorenulls=True).over(upto)["v"]

    placed = judged.select(
        *keys,
        "i",
        "file",
        "body",
        F.sum(F.col("git").cast("int")).over(upto).alias("blk"),
        F.count("hs").over(upto).alias("hno"),
        since_git("hs").alias("hstart"),
        since_git("file").alias("cur"),
    )
    counted = placed.groupBy(*keys, "blk", "hno").agg(
        F.max(F.when(F.col("file").isNotNull(), F.struct("i", "file"))).alias("named"),
        F.max("hstart").alias("start"),
        F.count_if(F.col("body") & F.col("hstart").isNotNull() & F.col("cur").isNotNull()).alias("n"),
    )
    # All hunks of a block belong to the file named last in it.
    owned = counted.withColumn("path", F.max("named").over(Window.partitionBy(*keys, "blk"))["file"]).where("n > 0 and path <> ''")
    # A later block for the same file replaces the earlier one.
    last = F.max("blk").over(Window.partitionBy(*keys, "path"))
    return (
        owned.withColumn("_last", last)
        .where("blk = _last")
        .select(*keys, "path", "start", (F.col("start") + F.col("n") - 1).cast("int").alias("end"))
    )


def _read_in_row(text: str) -> Column:
    """Whether ``_blocks_in_row`` reads a diff: a limited size, line feeds as its only line breaks, starts of less than ten digits."""
    t = F.col(text)
    rare = t.rlike(_RARE_BREAKS) | t.contains("\u2028") | t.contains("\u2029") | t.rlike(r"@@ -[\d,]+ \+\d{10}")
    return (F.length(t) <= _ROW_CHARS) & ~rare


def _blocks_in_row(text: str) -> Column:
    """The files of one diff with their hunks, in the order of its blocks: what ``diff_hunks`` finds.

    Marks, which no such text holds, take the place of line feeds in front of blocks, names, hunks and counted lines.
    Cutting at a single character is cheap, where a longer separator would be compiled as a pattern again per text.
    """
    t = F.col(text)
    git, name, hunk, line = "\x1e", "\x1c", "\x1d", "\x0b"
    marked = F.concat(F.lit("\n"), F.when(t.endswith("\n"), F.left(t, F.length(t) - 1)).otherwise(t))
    for old, new in (("\ndiff --git ", git), ("\ndiff --cc ", git), ("\n+++ ", name)):
        marked = F.replace(marked, F.lit(old), F.lit(new))
    marked = F.regexp_replace(marked, rf"\n(?={_HUNK_HEAD})", hunk)
    marked = F.regexp_replace(marked, r"\n(?![-\\])", line)

    def first_line(x: Column) -> Column:
        return reduce(lambda acc, mark: F.substring_index(acc, mark, 1), ("\n", line, hunk), x)

    def ranged(h: Column) -> Column:
        start = F.regexp_extract(h, r"\+(\d+)", 1).cast("int")
        n = F.size(F.split(h, line)) - 1
        return F.struct(start.alias("start"), (start.cast("long") + n - 1).cast("int").alias("end"))

    def counted(b: Column, names: Column) -> Column:
        """The block from its first name on: lines in front of it don't count, but a hunk that begins there goes on."""
        before = F.get(names, 0)
        head = F.regexp_extract(F.substring_index(before, hunk, -1), _HUNK_HEAD, 0)
        return F.when(before.contains(hunk), F.concat(F.lit(hunk), head, F.substring(b, F.length(before) + 1, F.length(b)))).otherwise(b)

    def hunks(b: Column, names: Column) -> Column:
        pieces = F.split(counted(b, names), hunk)
        return F.filter(let(pieces, lambda ps: F.transform(F.slice(ps, 2, F.size(ps)), ranged)), lambda r: r["end"] >= r["start"])

    def block(b: Column) -> Column:
        # All hunks of a block belong to the file named last in it.
        def of(names: Column) -> Column:
            path = _file_of(F.concat(F.lit("+++ "), first_line(F.element_at(names, -1))))
            return F.when(F.size(names) > 1, F.struct(path.alias("path"), hunks(b, names).alias("hunks")))

        return let(F.split(b, name), of)

    return F.filter(F.transform(F.split(marked, git), block), lambda x: (x["path"] != "") & (F.size(x["hunks"]) > 0))


def _merged_in_row(hunks: Column) -> Column:
    """Ranges that neither overlap nor touch, of the hunks of one file."""

    def step(done: Column, r: Column) -> Column:
        top = F.element_at(done, -1)
        joined = F.struct(top["start"].alias("start"), F.greatest(top["end"], r["end"]).alias("end"))
        apart = (F.size(done) == 0) | (r["start"] > F.try_element_at(done, F.lit(-1))["end"] + 1)
        return F.when(apart, F.concat(done, F.array(r))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(F.size(hunks) == 1, hunks).otherwise(F.aggregate(F.array_sort(hunks), none, step))


def _ranges_in_row(diffs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``diff_parse`` of diffs that are one row of limited size each: no line and no hunk becomes a row."""
    blocks = diffs.select(*keys, _blocks_in_row(text).alias("_blocks"))
    # A later block for the same file replaces the earlier one.
    last = F.filter("_blocks", lambda b, i: ~F.exists(F.slice("_blocks", i + 2, F.size("_blocks")), lambda later: later["path"] == b["path"]))
    files = blocks.select(*keys, F.inline(F.when(F.size("_blocks") > 1, last).otherwise(F.col("_blocks"))))
    return files.select(*keys, "path", F.inline(_merged_in_row(F.col("hunks"))))


def diff_parse(diffs: DataFrame, keys: list[str], text: str = "diff_text") -> DataFrame:
    """Merged changed ranges: ``keys, path, start, end``.

    Nearly all diffs are read within their row, without a shuffle of lines. Diffs that share their keys are read line by
    line as one, and long or unusual ones line by line, too; hunks are few, so a plain window merges them.
    """
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    # Mostly empty: then there is nothing to join, and no text is sorted.
    shared = diffs.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    # One number says both, as a filter on the texts alone would move below the join and the texts be shuffled once per way.
    each = F.when(_read_in_row(text), F.lit(1).cast("long")).otherwise(2)
    told = diffs.select(*keys, text, each.alias("_each")).join(shared, reduce(Column.__and__, same), "left")
    # The number of partitions is given, as reading costs more than the size of compressed texts tells.
    parts = int(diffs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = told.select(*keys, text, F.greatest(F.coalesce("_rows", F.lit(1)), F.col("_each")).alias("_way")).repartition(parts, *keys)
    short = F.col("_way") == 1
    return _ranges_in_row(told.where(short), keys, text).unionByName(_ranges_by_lines(told.where(~short), keys, text))


def _ranges_by_lines(diffs: DataFrame, keys: list[str], text: str) -> DataFrame:
    w = Window.partitionBy(*keys, "path").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("start") > reach + 1), F.col("start"))
    return (
        diff_hunks(diffs, keys, text)
        .withColumn("_opened", opened)
        .withColumn("_island", F.last("_opened", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "path", "_island")
        .agg(F.max("end").alias("end"))
        .select(*keys, "path", F.col("_island").alias("start"), "end")
    )


def interval_coalesce(ranges: DataFrame, keys: list[str], chunk_lines: int = _CHUNK_LINES) -> DataFrame:
    """Merge closed ranges that overlap or touch.

    Ranges with the same start are merged before anything is sorted; after that a chunk of
    ``chunk_lines`` starts holds at most that many rows, whatever the size of the group.
    """
    chunk = chunk_of("start", chunk_lines)
    starts = ranges.groupBy(*keys, "start").agg(F.max("end").alias("end"))
    reach = with_running(starts, keys, ["start"], chunk, {"reach": Running("max_before", F.col("end"))})
    opened = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + 1), F.col("start"))
    islands = with_running(
        reach.withColumn("opened", opened), keys, ["start"], chunk, {"island": Running("last", F.col("opened"))}
    )
    return (
        islands.groupBy(*keys, "island")
        .agg(F.max("end").alias("end"))
        .select(*keys, F.col("island").alias("start"), "end")
    )


def diff_interval_match(findings: DataFrame, ranges: DataFrame, coalesced: bool = False) -> DataFrame:
    """Add ``in_pr_diff``: the start line of a SAST finding lies in a changed range.

    A range counts for the path of the finding or for its base name. Both share the base name, so findings and ranges
    meet by scan, bucket of 64 lines and base name, in one shuffle: a range is the bits of its lines there, and the bits
    of the ranges of the path and of the bare name are put together. No row is multiplied and files with many of both
    stay cheap. ``coalesced`` says that the ranges of a file neither overlap nor touch, as those of ``diff_parse``; all
    others are merged here.
    """
    merged = ranges if coalesced else interval_coalesce(ranges, ["scan_id", "path"])
    place, size = ["_scan", "_at", "_name"], 1 << _BUCKET_BITS
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    at = F.explode(F.sequence(F.shiftright(start, _BUCKET_BITS), F.shiftright(end, _BUCKET_BITS)))
    first, last = F.greatest(F.col("_s") - F.col("_at") * size, F.lit(0)).cast("int"), F.least(F.col("_e") - F.col("_at") * size, F.lit(size - 1)).cast("int")
    changed = (
        merged.where("scan_id is not null and path is not null and start <= end")
        .select(F.col("scan_id").alias("_scan"), base_name("path").alias("_name"), F.col("path").alias("_path"), start.alias("_s"), end.alias("_e"), at.alias("_at"))
        .select(*place, "_path", F.call_function("shiftleft", F.lit(-1).cast("long"), first).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(size - 1) - last)).alias("_bits"))
    )
    may = (F.col("source_type") == "sast") & F.col("line_start").isNotNull() & (F.col("file_path") != "") & F.col("scan_id").isNotNull()
    # Findings that cannot match have no name; a hash of their own spreads them over the partitions.
    own = [c for c in ("finding_id", "report_id", "ordinal") if c in findings.columns] or [c for c, t in findings.dtypes if "map<" not in t and "variant" not in t]
    apart = -1 - F.pmod(F.xxhash64("scan_id", *own), F.lit(1 << 20))
    kept = [c for c in findings.columns if c != "in_pr_diff"]
    asked = findings.select(
        *kept, F.lit(True).alias("_asked"), F.when(may, F.col("scan_id")).alias("_scan"), F.when(may, base_name("file_path")).alias("_name"), F.when(may, F.col("file_path")).alias("_path"),
        F.when(may, F.shiftright(F.col("line_start").cast("long"), _BUCKET_BITS)).otherwise(apart).alias("_at"),
    )
    met = asked.unionByName(changed, allowMissingColumns=True).repartition(*place)
    of_path = F.bit_or("_bits").over(Window.partitionBy(*place, "_path"))
    of_name = F.bit_or(F.when(F.col("_path") == F.col("_name"), F.col("_bits"))).over(Window.partitionBy(*place))
    found = met.withColumn("_of_path", of_path).withColumn("_of_name", of_name).where("_asked")
    none = F.lit(0).cast("long")
    bits = F.coalesce("_of_path", none).bitwiseOR(F.coalesce("_of_name", none))
    line = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("line_start", F.lit(size)).cast("int"))
    return found.select(*kept, (F.col("_name").isNotNull() & F.coalesce(bits.bitwiseAND(line) != 0, F.lit(False))).alias("in_pr_diff"))
