"""Document quality by a classifier and by the site a document comes from (hierarchical empirical Bayes).

A logistic classifier gives each text its own evidence: which words it holds, how often words start in a certain
way (compounds and inflected forms are too rare one by one), and its form. Sites are hosts and paths below them. The mean evidence of
a host is shrunk toward the global mean, that of a path toward its host, each by as much as the spread between
hosts (paths) tells: a sparse site stands near its parent, a large one near its own mean. A document's posterior
is its own evidence with the site's prior in place of the global one; the document itself doesn't count in its
site's. Sums per site are aggregated before the shuffle, so a host with a third of all documents is a row a task.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findmill.llm.common import blank, give_back, materialise, small_batches, word_hashes, word_starts

#: Labelled rows that the classifier is fitted on (those with the smallest hashes of their ids), and words it keeps.
SAMPLE, TERMS = 8_192, 2_048
#: Bytes of a word's start, and starts that the classifier keeps.
STARTS, START_TERMS = (4, 5, 6), 512
#: A start counts as its share of the words in percent, up to MOST; texts of fewer words than FEW count as so many.
MOST, FEW = 4.0, 20
#: Bits of a word's hash used as a feature.
BITS = 18

_PUNCTUATION = bytes(i if chr(i).isalnum() or i > 127 else 32 for i in range(256))
_LOWER = bytes(range(256)).lower()
#: Measures of form: shares of bytes and words, and two lengths.
N_FORM = 10


def _form(text: bytes, words: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text, dtype=np.uint8)
    n = max(1, len(raw))
    kind = np.bincount(_KIND[raw], minlength=5) / n
    lines = text.split(b"\n")
    once = len(set(lines)) / len(lines)
    return np.array([*kind, once, len(set(words.tolist())) / max(1, len(words)), math.log1p(len(words)), len(raw) / max(1, len(words)) / 10, 1.0])


_KIND = np.array([0 if chr(i).islower() and i < 128 else 1 if chr(i).isupper() and i < 128 else 2 if 48 <= i < 58 else 3 if i in (9, 10, 11, 12, 13, 32) or i > 127 else 4 for i in range(256)], dtype=np.int64)


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Distinct hashed words (lower case, without punctuation), hashed starts, number of words and measures of form of a text."""
    plain = text.translate(_LOWER).translate(_PUNCTUATION)
    words = word_hashes(plain)
    return np.unique(_place(words)), _place(word_starts(plain, STARTS)), len(words), _form(text, words)


def _share(count: np.ndarray, words: int) -> np.ndarray:
    return np.minimum(100.0 * count / max(FEW, words), MOST)


class Classifier:
    """Two-class logistic regression over selected words, selected starts of words and form.

    ``starts`` and ``shares`` are the distinct starts of each text and their shares of its words.
    """

    def __init__(self, words: list[np.ndarray], starts: list[np.ndarray], shares: list[np.ndarray], form: np.ndarray, label: np.ndarray) -> None:
        self.mean, self.scale = form.mean(0), form.std(0) + 1e-9
        self.rate = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
        self.place, self.begins = np.full(1 << BITS, -1, dtype=np.int32), np.full(1 << BITS, -1, dtype=np.int32)
        row, flat = _flat(words)
        pos = np.bincount(flat, weights=label[row], minlength=1 << BITS)
        n = np.bincount(flat, minlength=1 << BITS)
        expect = n * self.rate
        z = np.abs(pos - expect) / np.sqrt(expect * (1 - self.rate) + 1)
        chosen = np.argsort(-z, kind="stable")[:TERMS]
        chosen = chosen[z[chosen] > 2]
        self.place[chosen] = np.arange(len(chosen))
        begin_row, begin = _flat(starts)
        share = np.concatenate(shares).astype(np.float64)
        z = _apart(begin, share, label[begin_row], label)
        begins = np.argsort(-z, kind="stable")[:START_TERMS]
        begins = begins[z[begins] > 3]
        self.begins[begins] = np.arange(len(begins))
        self.n_words, self.n_begins = len(chosen), len(begins)
        x = np.zeros((len(words), len(chosen) + len(begins) + N_FORM), dtype=np.float32)
        at = self.place[flat]
        x[row[at >= 0], at[at >= 0]] = 1
        at = self.begins[begin]
        x[begin_row[at >= 0], len(chosen) + at[at >= 0]] = share[at >= 0]
        x[:, len(chosen) + len(begins):] = self._scaled(form)
        self.weights = _fit(x, label)

    def _scaled(self, form: np.ndarray) -> np.ndarray:
        out = np.clip((form - self.mean) / self.scale, -5, 5)
        out[..., -1] = 1
        return out

    def score(self, measured: tuple[np.ndarray, np.ndarray, int, np.ndarray]) -> float:
        """Log-odds of the class of a text with these ``features``."""
        words, starts, n, form = measured
        at, begin = self.place[words], self.begins[starts]
        share = _share(np.bincount(begin[begin >= 0], minlength=self.n_begins), n)
        of_starts, of_form = self.weights[self.n_words:self.n_words + self.n_begins], self.weights[self.n_words + self.n_begins:]
        return float(np.clip(self.weights[at[at >= 0]].sum() + share @ of_starts + self._scaled(form) @ of_form, -12, 12))


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the part of each value, and the values."""
    return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts) if len(parts) else np.empty(0, dtype=np.int64)


def _apart(at: np.ndarray, value: np.ndarray, its_label: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How many standard errors the classes' mean values stand apart at each place."""
    n, ones = len(label), max(1.0, label.sum())
    total, square, one = (np.bincount(at, weights=w, minlength=1 << BITS) for w in (value, value * value, value * its_label))
    zeros = max(1.0, n - ones)
    spread = np.maximum(square / n - (total / n) ** 2, 0)
    return np.abs(one / ones - (total - one) / zeros) / np.sqrt(spread * (1 / ones + 1 / zeros) + 1e-7)


def _fit(x: np.ndarray, label: np.ndarray, penalty: float = 0.05, rounds: int = 1_000) -> np.ndarray:
    """Weights with a squared penalty, by accelerated gradient steps."""
    y = label.astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    step = 4.0 / (float(np.linalg.norm(x[:, -N_FORM:], axis=1).max()) ** 2 + float(np.einsum("ij,ij->i", x[:, :-N_FORM], x[:, :-N_FORM]).max()) + 1)
    keep = np.full(x.shape[1], penalty / max(1, len(x)), dtype=np.float32)
    keep[-1] = 0
    look, before = w, w
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(x @ look)))
        w = look - step * (x.T @ (p - y) / len(x) + keep * look)
        look = w + k / (k + 3) * (w - before)
        before = w
    return w.astype(np.float64)


def _sample(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...], sample: int) -> DataFrame:
    """(target, doc_id, y, features) of at most ``sample`` labelled documents of each target; each is measured once for all targets."""
    wanted = None
    for target in targets:
        of = labels.filter(F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        of = of.select("doc_id", F.struct(F.lit(target).alias("target"), "y").alias("label"))
        wanted = of if wanted is None else wanted.unionByName(of)
    # at most ``sample`` labels of each target
    wanted = materialise(wanted.groupBy("doc_id").agg(F.collect_list("label").alias("labels")), "quality-labels")
    kind = T.StructType([*[T.StructField(c, T.BinaryType()) for c in ("w", "s", "r")], T.StructField("f", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(kind)
    def measured(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words, starts, n, form = features(bytes(t))
            starts, count = np.unique(starts, return_counts=True)
            out.append((words.astype("<i4").tobytes(), starts.astype("<i4").tobytes(), _share(count, n).astype("<f4").tobytes(), form))
        return pd.DataFrame(out, columns=["w", "s", "r", "f"])

    rows = docs.select("doc_id", blank().alias("t")).join(F.broadcast(wanted), "doc_id").select("doc_id", "labels", measured("t").alias("m"))
    one = rows.groupBy("doc_id").agg(F.first("labels").alias("labels"), F.min(F.struct("m.w", "m.s", "m.r", "m.f")).alias("m"))
    return one.select("doc_id", F.inline("labels"), "m.*")


def train(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...], sample: int = SAMPLE) -> dict[str, Classifier]:
    """A classifier for each target (a column of 0/1, nulls ignored) whose labels have two classes, from at most ``sample`` labelled documents.

    Fitted in a task of its own for each target; the driver gets weights only.
    """
    small_batches(docs.sparkSession)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        y = rows["y"].to_numpy(dtype=np.float64)
        fitted = []
        if len(set(y.tolist())) == 2:
            words, starts = ([np.frombuffer(x, dtype="<i4") for x in rows[c]] for c in ("w", "s"))
            fitted.append((rows["target"].iloc[0], pickle.dumps(Classifier(words, starts, [np.frombuffer(x, dtype="<f4") for x in rows["r"]], np.stack(rows["f"].to_list()), y))))
            give_back()
        return pd.DataFrame(fitted, columns=["target", "fitted"])

    found = _sample(docs, labels, targets, sample).groupBy("target").applyInPandas(fit, "target string, fitted binary")
    return {r.target: pickle.loads(bytes(r.fitted)) for r in found.collect()}


def evidence(*classifiers: Classifier | None) -> Column:
    """Probability of each classifier's class by the text alone, as fields p0, p1, ...; 0.5 without a classifier."""
    names = [f"p{i}" for i in range(len(classifiers))]

    @F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in names]))
    def own(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            measured = features(bytes(t)) if any(classifiers) else None
            out.append([0.5 if c is None else 1 / (1 + math.exp(-c.score(measured))) for c in classifiers])
        give_back()
        return pd.DataFrame(out, columns=names, dtype="float64")

    return own(blank())


def _strength(between: float | None, mean: float) -> float:
    """How many documents a parent's mean counts for, from the variance between sites (method of moments)."""
    if between is None or between <= 1e-9:
        return 1e6
    return float(np.clip(mean * (1 - mean) / between - 1, 1.0, 1e6))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """(host, path, n, s, host_mean) per path, the global mean, and the strength of a host's mean for its paths.

    ``scored``: host, path, p; a null host or path is a site of its own.
    """
    paths = materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")), "quality-paths")
    hosts = materialise(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss")), "quality-hosts")
    total = hosts.agg(F.sum("hn"), F.sum("hs"), F.sum("hss"), F.count("*")).first()
    n, s = total[0] or 0, total[1] or 0.0
    if not n:
        return paths.withColumn("host_mean", F.lit(0.5)), 0.5, 1e6
    mean = min(max(s / n, 1e-6), 1 - 1e-6)
    within = max(total[2] / n - mean * mean, 0.0)

    def spread(table: DataFrame, count: str, value: str, centre: Column) -> float:
        # variance of site means around their centre, less what the variance within sites explains
        got = table.filter(F.col(count) > 1).agg(F.avg((F.col(value) / F.col(count) - centre) ** 2 - within / F.col(count))).first()[0]
        return _strength(got, mean)

    k_host = spread(hosts, "hn", "hs", F.lit(mean))
    hosts = hosts.withColumn("host_mean", (F.col("hs") + k_host * mean) / (F.col("hn") + k_host))
    joined = materialise(paths.join(hosts.select("host", "host_mean"), paths.host.eqNullSafe(hosts.host)).select(paths.host, "path", "n", "s", "host_mean"), "quality-sites")
    return joined, mean, spread(joined, "n", "s", F.col("host_mean"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def with_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with q_host, q_path, p_text, p_toxic, p_quality and keep; of the columns of ``docs`` those named by ``keep``, or all.

    The column ``keep`` is p_quality >= 0.5 and p_toxic < 0.5. Without labels of both classes a classifier has no say (0.5 by
    the text alone, and nothing is toxic). A null text is judged as an empty one. Repeated rows are judged each
    for itself; no rows give no rows. Columns of ``docs`` with the names above are replaced; other names may clash
    with nothing, as the columns travel as one struct. Evidence is computed once and written; sites and posteriors
    read it there.
    """
    fitted = train(docs, labels, ("quality", "toxic"), sample)
    quality, toxic = fitted.get("quality"), fitted.get("toxic")
    own = ("q_host", "q_path", "p_text", "p_toxic", "p_quality", "keep")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).alias("none"))
    small_batches(docs.sparkSession)
    scored = docs.select(row.alias("row"), host.alias("host"), path.alias("path"), evidence(quality, toxic).alias("p"))
    scored = materialise(scored.select("row", "host", "path", F.col("p.p0").alias("p"), (F.col("p.p1") if toxic else F.lit(0.0)).alias("toxic")), "quality-evidence")
    sites, mean, k = site_posteriors(scored.select("host", "path", "p"))
    sites = sites.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "n", "s", "host_mean")
    found = scored.join(sites, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    prior = (F.col("s") - F.col("p") + k * F.col("host_mean")) / (F.col("n") - 1 + k)
    posterior = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(F.col("q_path")) - _logit(F.lit(mean)))))
    found = found.withColumn("q_path", prior).withColumn("p_quality", posterior)
    return found.select(
        *[F.col(f"row.`{c}`") for c in kept], F.col("host_mean").alias("q_host"), "q_path", F.col("p").alias("p_text"), F.col("toxic").alias("p_toxic"), "p_quality",
        ((F.col("p_quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("keep"),
    )
