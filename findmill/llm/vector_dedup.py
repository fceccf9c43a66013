"""Near-duplicate vectors by product quantisation over coarse inverted lists, with an exact cosine check.

- Equal vectors of one label are one class; only its smallest id is searched, its size counts.
- Coarse centroids and the codebooks of the residuals' subspaces are fitted on at most ``SAMPLE`` vectors, drawn
  by a hash of the id. Every vector is indexed: in the list of its nearest centroid, with the codes of its
  residual and the length of what the codes leave over.
- A vector probes each list whose half-space comes within the search radius of it. Two unit vectors with cosine c
  are sqrt(2 - 2c) apart, so no list that can hold a partner is left out.
- Table look-ups give the distance to a coded vector; its true distance differs by at most the left-over length.
  What may be within the radius is compared exactly in double precision. So no link is lost, whatever the codes.
- Lists are cut into tiles of at most ``TILE`` vectors by ``TILE`` probes. A tile returns sums and one label per
  vector, never pairs; a crowd of near copies costs arithmetic but no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findmill.llm.common import materialise, small_batches
from findmill.llm.components import connected_components

#: Vectors that centroids and codebooks are fitted on; most coarse lists; codewords and width of a subspace.
SAMPLE, LISTS, WORDS, WIDTH = 16_384, 1_024, 256, 4
TILE = 2_048


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``x``; starts from evenly spaced rows, so the same rows give the same centres."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class Codes:
    """Coarse centroids and residual codebooks for vectors of one width."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.parts = [slice(a, min(a + WIDTH, sample.shape[1])) for a in range(0, sample.shape[1], WIDTH)]
        self.books = [kmeans(rest[:, p], WORDS) for p in self.parts]
        self.gaps = np.sqrt(np.maximum(0, ((self.coarse[:, None] - self.coarse[None]) ** 2).sum(2))) if len(self.coarse) <= 256 else None

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and left-over length of unit vectors."""
        cell = _nearest(x, self.coarse)
        rest = x - self.coarse[cell]
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            rest[:, p] -= b[codes[:, k]]
        return cell, codes, np.linalg.norm(rest, axis=1)

    def probes(self, x: np.ndarray, cell: int, radius: float) -> np.ndarray:
        """Lists whose vectors may lie within ``radius`` of ``x``: those whose half-space does."""
        d = ((self.coarse - x) ** 2).sum(1)
        gap = self.gaps[cell] if self.gaps is not None else np.sqrt(((self.coarse - self.coarse[cell]) ** 2).sum(1))
        return np.flatnonzero(d - d[cell] <= 2 * gap * radius + 1e-9)

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to coded vectors of one list, by table look-up."""
        rest = q - self.coarse[cell]
        out = np.zeros((len(q), len(codes)))
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            table = (rest[:, p] ** 2).sum(1)[:, None] + (b**2).sum(1) - 2 * rest[:, p] @ b.T
            out += table[:, codes[:, k]]
        return np.sqrt(np.maximum(out, 0))


def _vectors(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=np.float64) for v in column])


def vector_links(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and their cosine is at least ``threshold``. Vectors
    that are null, empty, all zero or hold a null or non-finite component, and vectors of different width, link
    with nothing: 0 links, their own component. No rows give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    e = F.col("embedding").cast("array<double>")
    usable = F.expr("vec_id is not null and label is not null and embedding is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(e, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", e.alias("e")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.filter("usable").select("vec_id", "label", "e")
    classes = materialise(good.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    widths = [r[0] for r in classes.select(F.size("e").alias("w")).distinct().collect()]  # one width as a rule
    parts, links = [], []
    for w in sorted(widths):
        found = materialise(_search(classes.filter(F.size("e") == w), threshold), "vector-tiles")
        parts.append(found.select("id", "linked"))
        links.append(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    if not widths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    while len(parts) > 1:
        parts, links = [parts[0].union(parts[1]), *parts[2:]], [links[0].union(links[1]), *links[2:]]
    counts = parts[0].groupBy(F.col("id").alias("rep")).agg(F.sum("linked").alias("linked"))
    component = connected_components(links[0]).withColumnRenamed("id", "rep")
    result = classes.join(counts, "rep", "left").join(component, "rep", "left")
    # equal vectors link with each other
    result = materialise(result.select("label", "e", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-result")
    joined = good.join(result, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _search(classes: DataFrame, threshold: float) -> DataFrame:
    """Per tile: (id, linked: how many other vectors, root: smallest id of the tile's links that reach it)."""
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("e").collect()
    codes = Codes(_unit(np.array([r[0] for r in sample])), int(np.clip(round(n**0.5), 1, LISTS)))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-7
    radius_sent = classes.sparkSession.sparkContext.broadcast(codes)  # bounded by LISTS, WORDS and the vectors' width

    def index(batches):
        held = radius_sent.value
        for pdf in batches:
            if not len(pdf):
                continue
            raw = np.stack(pdf["e"].to_numpy()).astype(np.float64)
            x = _unit(raw)
            cell, code, rest = held.encode(x)
            yield pd.DataFrame({
                "label": pdf["label"], "id": pdf["rep"], "copies": pdf["copies"], "cell": cell, "code": [c.tobytes() for c in code], "rest": rest,
                "vector": [v.tobytes() for v in raw], "probes": [held.probes(v, c, radius) for v, c in zip(x, cell, strict=True)],
            })

    kind = classes.schema["label"].dataType.simpleString()
    listed = materialise(classes.mapInPandas(index, f"label {kind}, id long, copies long, cell int, code binary, rest double, vector binary, probes array<int>"), "vector-lists")
    probing = listed.select("label", "id", "vector", F.explode("probes").alias("cell"))
    sizes = listed.groupBy("label", "cell").agg(F.ceil(F.count("*") / TILE).alias("m_tiles")).join(probing.groupBy("label", "cell").agg(F.ceil(F.count("*") / TILE).alias("p_tiles")), ["label", "cell"])
    sizes = materialise(sizes, "vector-sizes")
    part = F.xxhash64("id")
    keys = ["label", "cell", "m", "p"]
    members = listed.join(sizes, ["label", "cell"]).withColumn("m", F.pmod(part, "m_tiles")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_tiles") - 1)))
    probes = probing.join(sizes, ["label", "cell"]).withColumn("p", F.pmod(part, "p_tiles")).withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_tiles") - 1)))

    def tile(key, m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "linked": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if not len(m) or not len(p):
            return empty
        held, cell = radius_sent.value, int(key[1])
        m = m.sort_values("id")
        raw, ids, copies = _vectors(m["vector"]), m["id"].to_numpy(), m["copies"].to_numpy()
        norm = np.linalg.norm(raw, axis=1)
        code, reach = np.stack([np.frombuffer(c, dtype=np.uint8) for c in m["code"]]), m["rest"].to_numpy() + radius
        label = ids.copy()  # smallest id of the links of this tile that reach the member
        q_raw, q_ids = _vectors(p["q_vector"]), p["q_id"].to_numpy()
        q_norm = np.linalg.norm(q_raw, axis=1)
        linked, at = np.zeros(len(q_ids), dtype=np.int64), np.full(len(q_ids), -1)
        for a in range(0, len(q_ids), 256):
            near = held.distances(q_raw[a:a + 256] / q_norm[a:a + 256, None], cell, code) <= reach + 1e-7
            for i in np.flatnonzero(near.any(axis=1)):
                k = a + int(i)
                c = np.flatnonzero(near[i])
                c = c[ids[c] != q_ids[k]]
                c = c[(raw[c] @ q_raw[k]) / (norm[c] * q_norm[k]) >= threshold]
                if not len(c):
                    continue
                linked[k], at[k] = copies[c].sum(), c[0]
                roots = np.unique(np.append(label[c], q_ids[k]))
                mine = roots[roots != roots[0]]
                label[np.isin(label, mine)] = roots[0]
                label[c] = roots[0]
        has = at >= 0
        # the probe itself may stand among the members of another tile only, so it is tied to a partner's label
        out = pd.DataFrame({"id": q_ids[has], "linked": linked[has], "root": label[at[has]]})
        touched = label != ids
        return pd.concat([out, pd.DataFrame({"id": ids[touched], "linked": 0, "root": label[touched]})])

    columns = [*keys, "id", "vector"]
    probes = probes.select(*[F.col(c).alias(f"q_{c}") for c in columns])
    tiles = members.select(*columns, "code", "rest", "copies").groupBy(*keys).cogroup(probes.groupBy(*[f"q_{k}" for k in keys]))
    return tiles.applyInPandas(tile, "id long, linked long, root long")
