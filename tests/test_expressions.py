import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from findmill import constants as K
from findmill.functions import evidence as ev
from findmill.functions import findings as fx
from findmill.functions import text as tx
from findmill.functions.sql import register_sql_functions
from findmill.sources import corpus

# Credential-like strings are put together here, none is stored.
AWS = "AKIA" + "A1B2C3D4E5F6G7H8"
LIVE = "sk_" + "live_" + "0123456789abcdefXYZ"


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["v"] for r in df.select("i", make("x").alias("v")).orderBy("i").collect()]


def test_severity(spark):
    given = ["UNKNOWN", "gibberish", None, "", " Moderate\t", "ERROR", "warning", "note", "informational", "Critical"]
    assert column(spark, given, fx.sev_normalize) == ["info", "low", "low", "low", "medium", "high", "medium", "info", "info", "critical"]
    assert column(spark, ["none", "critical", "odd"], fx.sev_rank) == [5, 0, None]
    assert column(spark, ["odd", "low"], fx.sev_display) == ["info", "low"]


@pytest.mark.parametrize(
    "doc, want",
    [('"89"', "CWE-89"), ('"CWE-89"', "CWE-89"), ('["CWE-89"]', "CWE-89"), ('{"id": "89"}', "CWE-89"), ("null", ""), ("89", "CWE-89"),
     ("[]", ""), ('{"name": "cwe-7"}', "CWE-7"), ('{"id": "", "name": "5"}', "CWE-5"), ('""', "")],
)
def test_cwe(spark, doc, want):
    assert column(spark, [doc], lambda c: fx.cwe_normalize(F.parse_json(c))) == [want]


def test_rule_id(spark):
    assert column(spark, ["home.user.x.scp.python.exec.eval", "plain", None], fx.rule_id_clean) == ["scp.python.exec.eval", "plain", ""]


def test_strict_booleans(spark):
    words = ["1", "true", "YES", " on ", "0", "False", "no", "off", "", "  ", None]
    got = column(spark, words, lambda c: tx.parse_bool(c)["value"])
    assert got == [True] * 4 + [False] * 7
    bad = ["banana", "2", "truefalse", "y", "n", "on1"]
    assert column(spark, bad, lambda c: tx.parse_bool(c)["value"]) == [None] * 6
    assert all(column(spark, bad, lambda c: tx.parse_bool(c)["error"]))


def test_markup(spark):
    assert column(spark, ["<a href='x'>y</a> & more"], tx.markup_escape) == ["&lt;a href='x'&gt;y&lt;/a&gt; &amp; more"]


def test_paths(spark):
    cases = {
        "/work/src/x.py": "src/x.py", "src/x.py": "src/x.py", "../x": "", "/etc/passwd": "", "": "", "./a//b/./c": "a/b/c",
        "a/../../work/b": "b", "/work": ".", "/work/": ".", "/workshop/a": "", "a/../b": "b", "/work/a/../../x": "", "a/..": ".",
    }
    assert dict(zip(cases, column(spark, list(cases), lambda c: fx.path_relativize(c, "/work")))) == cases


def test_paths_against_posixpath(spark):
    rng = random.Random(3)
    given = ["/".join(rng.choice(["a", "b", "..", ".", "", "work"]) for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def want(p):
        if not p:
            return p
        full = posixpath.normpath(posixpath.join("/work", p)).replace("//", "/")
        return "." if full == "/work" else full[6:] if full.startswith("/work/") else ""

    assert column(spark, given, lambda c: fx.path_relativize(c, "/work")) == [want(p) for p in given]


def test_sql_functions_agree(spark):
    register_sql_functions(spark)
    paths = ["/work/a/./b", "../x", "", "a/../..", "/work", "plain/x.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.selectExpr("path_relativize(p, '/work') AS v").collect()
    assert [r["v"] for r in got] == column(spark, paths, lambda c: fx.path_relativize(c, "/work"))
    one = spark.createDataFrame([(LIVE,)], "t string").selectExpr("redact(concat('x ', t), array('none')) AS r", "sev_normalize(' Error ') AS s").first()
    assert (one["r"], one["s"]) == ("x [REDACTED]", "high")


def test_lines_and_strip_follow_python(spark):
    rng = random.Random(5)
    alphabet = ["a", " ", "\n", "\r", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x1e", "\x1f", "\x85", " ", " ", " ", "é"]
    given = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8))) for _ in range(500)]
    assert column(spark, given, tx.split_lines) == [g.splitlines() for g in given]
    assert column(spark, given, tx.strip) == [g.strip() for g in given]


def test_redaction(spark):
    text = f"key {AWS} and {LIVE}; Password = 'hunter2hunter2' token:short ok"
    out = column(spark, [text], tx.redact)[0]
    assert AWS not in out and LIVE not in out and "hunter2" not in out and "token:short ok" in out
    assert out.count(K.REDACTED) == 3
    begin = "-----BEGIN RSA " + "PRIVATE KEY-----"
    assert column(spark, [begin], tx.redact) == [K.REDACTED]
    exact = spark.createDataFrame([("abc abcd", ["abc", "abcd", None])], "x string, t array<string>")
    assert exact.select(tx.redact("x", "t").alias("v")).first()["v"] == "abc [REDACTED]"


def test_redaction_follows_python_patterns(spark):
    rng = random.Random(11)
    parts = ["api_key", "SECRET", "toKen", "ſecret", "paſſword", " = ", ":", "=", '"', "abcdefgh1", "short", AWS, "é", "x", " ", "\n", "authorızation"]
    given = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(600)]

    def want(t):
        for rx in K.CREDENTIAL_PATTERNS.values():
            t = re.sub(rx, K.REDACTED, t)
        return t

    # Python folds the dotless i differently; texts with it only have to be redacted alike or more.
    plain = [g for g in given if "ı" not in g]
    assert column(spark, plain, tx.redact) == [want(g) for g in plain]


def test_secret_match_is_masked_before_the_cut(spark):
    df = spark.createDataFrame([("x" * 195 + "topsecretvalue", "topsecretvalue")], "m string, s string")
    out = df.select(tx.redact_match("m", "s").alias("v")).first()["v"]
    assert len(out) == 200 and "tops" not in out


def test_fingerprint_keeps_every_field(spark):
    import hashlib

    df = spark.createDataFrame([("t", None, "p", None, "  s\t\n")], "a string, b string, c string, d int, e string")
    assert df.select(tx.fingerprint("a", "b", "c", "d", "e").alias("v")).first()["v"] == hashlib.sha256(b"t||p|N/A|s").hexdigest()


def test_sizes_and_ints(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1048576,), (5 * 1048576 + 52429,)], "n long")
    assert [r["v"] for r in df.select(tx.human_size("n").alias("v")).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.1 MB"]
    assert column(spark, [" 7 ", "x", None, "-3", "1.5", ""], tx.first_int) == [7, None, None, -3, None, None]


def test_suffix_and_languages(spark):
    paths = ["a/b.PY", ".bashrc", "x.tar.gz", "noext", "dir.py/file", "..a.js", "k.tsx"]
    assert column(spark, paths, fx.path_suffix) == [".py", "", ".gz", "", "", ".js", ".tsx"]
    files = spark.createDataFrame(
        [("p", "a.vue"), ("p", "b.go"), ("p", "c.py"), ("p", ".git/d.rb"), ("p", "e.rs"), ("q", "x/.h/y.py"), ("p", "z.unknown")],
        "project string, path string",
    )
    assert {r["project"]: r["languages"] for r in corpus.language_inventory(files).collect()} == {"p": ["python", "go", "rust", "vue"]}


def test_evidence_parts(spark):
    df = spark.createDataFrame([('{"extra": {"metadata": {"references": ["a", "b"], "owasp": ["x"], "confidence": "low"}}, "more_info": "m"}', "http://r")], "j string, r string")
    row = df.withColumn("v", F.parse_json("j")).select(
        ev.evidence_references("v", "r").alias("refs"), ev.evidence_owasp("v").alias("o"), ev.evidence_confidence("v").alias("c")
    ).first()
    assert (row["refs"], row["o"], row["c"]) == (["a", "b", "m", "http://r"], "x", "LOW")


def test_member_types(spark):
    df = spark.createDataFrame(
        [("a", 0o100644), ("l", 0o120777), ("d/", 0), ("d", 0o040755), ("s", 0o140755), ("z", 0)], "f string, m long"
    ).withColumn("a", F.col("m") * 65536)
    assert [r["v"] for r in df.select(fx.member_type("f", "a").alias("v")).collect()] == ["file", "symlink", "dir", "dir", "special", "file"]


def test_strip_is_that_of_python(spark):
    """Every character, inside and at both ends."""
    from findmill.functions.text import strip

    texts = [c + "a" + c + "b" + c for c in map(chr, range(1, 0x3100))] + ["", " ", "\u2003\x1c\t", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip("t").alias("s")).collect()
    assert all(r.s == r.t.strip() for r in rows)
