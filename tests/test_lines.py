import random
import re

from findmill import constants as K
from findmill.operators import detect, diff
from findmill.operators.context import context_join, snippet_fallback
from findmill.operators.detect import Rule, rule_scan
from findmill.operators.diff import diff_interval_match, diff_parse
from findmill.sources.corpus import source_lines


def context_of(spark, content, start, end=None):
    files = spark.createDataFrame([("p", "f", content)], "project string, path string, content string")
    found = spark.createDataFrame([(1, "p", "f", start, end)], "id int, project string, file_path string, line_start int, line_end int")
    return [(c["line"], c["text"], c["vulnerable"]) for c in context_join(found, files).first()["context"]]


def test_source_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\n"), (2, ""), (3, "\n"), (4, "x")], "id int, content string")
    got = [(r["id"], r["line"], r["text"]) for r in source_lines(df).orderBy("id", "line").collect()]
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (3, 1, ""), (4, 1, "x")]


def test_context_window(spark):
    got = context_of(spark, "\n".join(f"line{i}" for i in range(1, 21)), 10)
    assert [g[0] for g in got] == list(range(6, 15)) and [g[0] for g in got if g[2]] == [10]


def test_context_long_file_and_giant_line(spark):
    got = context_of(spark, "\n".join(["safe"] * 20000 + ["bad"]), 20001)
    assert got[-1] == (20001, "bad", True) and len(got) == 5
    got = context_of(spark, "a\n" + "x" * 9000 + "\nb", 2)
    assert got[1] == (2, K.LINE_TRUNCATED, True)
    assert context_of(spark, "x" * 8192 + "\nb", 1) == []


def test_context_against_reading_line_by_line(spark):
    rng = random.Random(7)
    texts = {f"f{i}": "\n".join("é" * rng.choice([0, 3, 700, 2000, 5000]) for _ in range(rng.randint(0, 60))) for i in range(12)}
    found = [(i, "p", f"f{rng.randint(0, 12)}", rng.randint(1, 60), rng.choice([None, 5, 30, 70])) for i in range(200)]
    files = spark.createDataFrame([("p", n, t) for n, t in texts.items()], "project string, path string, content string")
    df = spark.createDataFrame(found, "id int, project string, file_path string, line_start int, line_end int")
    got = {r["id"]: [(c["line"], c["text"]) for c in r["context"]] for r in context_join(df, files).collect()}
    for i, _, name, start, end in found:
        lines = texts.get(name, "").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        want, used = [], 0
        for n in range(max(1, start - 4), min(len(lines), (end or start) + 4) + 1):
            t = lines[n - 1] if len(lines[n - 1].encode()) <= 8192 else K.LINE_TRUNCATED
            used += len(t.encode()) + 1
            if used > 8192 or len(want) == 25:
                break
            want.append((n, t))
        assert got[i] == want


def test_many_findings_on_one_line_look_up_once(spark):
    files = spark.createDataFrame([("p", "f", "a\nb\nc")], "project string, path string, content string")
    hot = spark.range(3000).selectExpr("id", "'p' AS project", "'f' AS file_path", "2 AS line_start", "cast(NULL AS int) AS line_end")
    out = context_join(hot, files)
    assert out.count() == 3000 and out.selectExpr("size(context) AS n").distinct().collect()[0]["n"] == 3


def test_snippet_fallback(spark):
    files = spark.createDataFrame([("p", "f", "one\ntwo\nthree"), ("p", "long", "x" * 5000 + "\ny")], "project string, path string, content string")
    rows = [(1, "f", 2, 2, None), (2, "f", 1, 9, None), (3, "f", 1, 1, "given"), (4, "none", 1, 1, None), (5, "f", 9, 9, None), (6, "long", 1, 2, None), (7, "f", 2, 0, None)]
    df = spark.createDataFrame([(i, "p", f, s, e, t) for i, f, s, e, t in rows], "id int, project string, file_path string, line_start int, line_end int, snippet string")
    got = {r["id"]: r["snippet"] for r in snippet_fallback(df, files).collect()}
    assert got == {1: "two", 2: "one\ntwo\nthree", 3: "given", 4: "", 5: "", 6: "x" * 2000, 7: "two"}


# ---------------------------------------------------------------- diffs
PR = """diff --git a/app.py b/app.py
index 1..2 100644
--- a/app.py
+++ b/app.py
@@ -5,15 +5,4 @@
 def login(user):
     one
     two
-    gone
+    new

 last"""


def ranges_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, diff_text string")
    return sorted((r["id"], r["path"], r["start"], r["end"]) for r in diff_parse(df, ["id"]).collect())


def test_diff_ranges(spark):
    assert ranges_of(spark, PR) == [(0, "app.py", 5, 10)]
    assert ranges_of(spark, "diff --git a/x b/x\nBinary files differ\n") == []
    # Without block headers the last file name takes all ranges; a later block replaces an earlier one.
    plain = "--- a/a\n+++ b/a\n@@ -1 +1 @@\n+x\n--- a/b\n+++ b/b\n@@ -1 +9 @@\n+y\n"
    assert ranges_of(spark, plain) == [(0, "b", 1, 1), (0, "b", 9, 9)]
    twice = "".join(f"diff --git a/a b/a\n+++ b/a\n@@ -1 +{n} @@\n+x\n" for n in (3, 8))
    assert ranges_of(spark, twice) == [(0, "a", 8, 8)]


def test_random_diffs(spark):
    """Diffs written from known ranges give these ranges back."""
    rng = random.Random(9)
    texts, want = [], []
    for _ in range(200):
        parts, files = [], {}
        for f in range(rng.randint(0, 4)):
            name, at, own = f"d/f{f}.py", 1, set()
            parts += [f"diff --git a/{name} b/{name}", f"index {f}..{f + 1} 100644", "--- /dev/null" if rng.random() < 0.3 else f"--- a/{name}", f"+++ b/{name}" + "\tdate" * rng.randint(0, 1)]
            for _ in range(rng.randint(0, 3)):
                at += rng.randint(0, 20)
                size = rng.randint(1, 6)
                body = [rng.choice(("+new", " same", "+")) for _ in range(size)]
                own |= set(range(at, at + size))
                for _ in range(rng.randint(0, 3)):
                    body.insert(rng.randint(0, len(body)), rng.choice(("-old", "\\ No newline at end of file")))
                parts += [f"@@ -{rng.randint(1, 9)},2 +{at},{size} @@ def f", *body]
                at += size
            if own:
                files[name] = own
        texts.append("\n".join(parts))
        want.append(files)
    got: dict = {}
    for i, path, s, e in ranges_of(spark, *texts):
        got.setdefault(i, {}).setdefault(path, set()).update(range(s, e + 1))
    assert [got.get(i, {}) for i in range(len(texts))] == want


def test_diffs_are_read_in_their_rows(spark, monkeypatch):
    """Only diffs that share keys, are long or have rare line breaks become rows of lines; both ways give the same ranges."""
    rng, words = random.Random(4), ["diff --git a/x b/x", "diff --cc y", "+++ b/a", "+++ b/b\tdate", "+++ ", "--- a/a", "--- /dev/null", "@@ -1 +3 @@", "@@ -1,2 +7,3 @@ f +1", "@@ bad", "@@ -1 +99999999999 @@", "+x", " y", "", "-o", "\\ No"]
    texts = ["\n".join(rng.choice(words) for _ in range(rng.randint(0, 25))) + "\n" * rng.randint(0, 2) for _ in range(2000)]
    texts += ["diff --git a/a b/a\r\n+++ b/a\r\n@@ -1 +3 @@\r\n+x\r\n", "+++ b/a\n@@ -1 +1 @@\n" + "+line of a long diff\n" * 4000, ""]
    df = spark.createDataFrame([*enumerate(texts), (5000, texts[0]), (5000, texts[0]), (None, texts[1]), (6000, None)], "id int, t string")
    by_lines, seen = diff._ranges_by_lines, []
    monkeypatch.setattr(diff, "_ranges_by_lines", lambda d, *a: seen.append({r["id"] for r in d.collect()}) or by_lines(d, *a))
    got = diff_parse(df, ["id"], "t")
    odd = {i for i, t in enumerate(texts) if "99999999999" in t}
    assert seen == [odd | {2000, 2001, 5000, 6000}] and len(odd) < 1900
    assert sorted(map(str, got.collect())) == sorted(map(str, by_lines(df, ["id"], "t").collect()))


def test_interval_match(spark):
    ranges = spark.createDataFrame([(1, "src/a.py", 5, 200), (1, "src/a.py", 150, 300), (1, "b.py", 1, 1)], "scan_id long, path string, start int, end int")
    rows = [(1, 1, "src/a.py", 5, "sast"), (2, 1, "src/a.py", 4, "sast"), (3, 1, "x/b.py", 1, "sast"), (4, 1, "src/a.py", 300, "secrets"),
            (5, 2, "src/a.py", 5, "sast"), (6, 1, "a.py", 5, "sast"), (7, 1, "src/a.py", None, "sast"), (8, 1, "src/a.py", 299, "sast"), (9, 1, "", 1, "sast")]
    df = spark.createDataFrame(rows, "id int, scan_id long, file_path string, line_start int, source_type string")
    got = {r["id"]: r["in_pr_diff"] for r in diff_interval_match(df, ranges).collect()}
    assert [i for i, hit in got.items() if hit] == [1, 3, 8] and len(got) == 9


def test_interval_match_in_one_shuffle(spark):
    """Random findings and ranges, with nulls and repeated rows, as if compared one by one; both sides meet by one exchange."""
    rng = random.Random(3)
    paths = ["a.py", "x/a.py", "y/x/a.py", "b.py", "x/b.py", "", None]
    number = lambda most: None if rng.random() < 0.05 else rng.randint(-70, most)
    ranges = [(rng.choice((1, 2, None)), rng.choice(paths), s, None if s is None else s + rng.randint(-1, 150)) for s in (number(900) for _ in range(40))]
    rows = [(i // 2, rng.choice((1, 2, None)), rng.choice(paths), number(1000), rng.choice(("sast", "sast", "sca", None))) for i in range(3000)]

    def hit(scan, path, line, kind):
        return bool(kind == "sast" and line is not None and path and scan) and any(r[0] == scan and r[1] in (path, path.split("/")[-1]) and r[2] is not None and r[2] <= line <= r[3] for r in ranges)

    df = spark.createDataFrame(rows, "finding_id int, scan_id long, file_path string, line_start int, source_type string").repartition(3)
    given = spark.createDataFrame(ranges, "scan_id long, path string, start int, end int").where("start <= end")
    want = sorted(str((*r, hit(*r[1:]))) for r in rows)
    assert sum("True" in r for r in want) > 50
    for coalesced in (True, False):  # lines of overlapping ranges are put together, too
        assert sorted(str(tuple(r)) for r in diff_interval_match(df, given, coalesced).collect()) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = diff_interval_match(df, given, True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ---------------------------------------------------------------- detection
def test_call_rules_hit_and_miss(spark):
    shell = detect.Rule("shell", ("python",), "ERROR", regexes=(detect.compile_call_pattern("subprocess.run(..., shell=True, ...)"),))
    load = detect.Rule("load", ("python",), "ERROR", regexes=(detect.compile_call_pattern("yaml.unsafe_load(...)"),))
    bad = "import subprocess\n\ndef f(c):\n    return subprocess.run(\n        g(c), shell=True, x=1)\n\nyaml.unsafe_load(d)\n"
    good = "subprocess.run(['a', f(x)], shell=False)\nyaml.safe_load(d)\nmy_subprocess.runner(shell=True)\n"
    files = spark.createDataFrame([("p", "bad.py", bad), ("p", "good.py", good), ("p", "bad.js", bad)], "project string, path string, content string")
    got = sorted((r["file_path"], r["line_start"], r["rule_id"]) for r in detect.rule_scan_calls(files, [shell, load]).collect())
    assert got == [("bad.py", 4, "shell"), ("bad.py", 7, "load")]


def test_other_call_shapes(spark):
    import re

    rx = detect.compile_call_pattern
    assert re.search(rx("$ELEM.innerHTML = $DATA"), "box.innerHTML = data") and not re.search(rx("$ELEM.innerHTML = $DATA"), "box.innerHTML == data")
    assert re.search(rx('exec.Command("sh", "-c", $ARG)'), 'exec.Command("sh",  "-c", cmd)')
    assert re.search(rx("Runtime.getRuntime().exec(...)"), "Runtime.getRuntime().exec(a, b)")
    assert not re.search(rx("eval(...)"), "literal_eval(x)") and re.search(rx("eval(...)"), "x = eval()")


def test_secret_rows_hold_no_secret_but_the_token(spark):
    token = "sk_" + "live_" + "0123456789abcdefXYZ"
    files = spark.createDataFrame([("p", "a.py", f"x\nk = {token} {token}\n"), ("p", "b.py", "nothing")], "project string, path string, content string")
    rows = detect.secret_scan(files).collect()
    assert [(r["line_start"], r["ordinal"]) for r in rows] == [(2, 0), (2, 1)]
    assert all(r["redaction_tokens"] == [token] and token not in str(r["snippet"]) for r in rows)


def test_matches_of_a_rule_do_not_overlap(spark):
    """As a search gives them, for each expression of a rule by itself."""
    text = "x = 1\n\n\n\neval(y)\neval(z) eval(w)\naaaa\n"
    files = spark.createDataFrame([("p", "a.py", text)], "project string, path string, content string")
    one = Rule("r", ("python",), "ERROR", regexes=(r"\s+eval",))
    two = Rule("s", ("python",), "ERROR", regexes=(r"(?s)x = 1.*z\)", r"eval\(y", r"aa"))
    got = sorted((r["rule_id"], r["line_start"]) for r in rule_scan(files, [one, two]).collect())
    want = {("r", 1 + text[:m.start()].count("\n")) for m in re.finditer(r"\s+eval", text)}
    want |= {("s", 1 + text[:m.start()].count("\n")) for rx in two.regexes for m in re.finditer(rx, text)}
    assert got == sorted(want) and ("r", 2) not in got and ("s", 5) in got
