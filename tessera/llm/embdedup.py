"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are turned to their principal axes and ordered by grid cells on the leading ones; the order is cut into
intervals. Two intervals are joined only where their boxes come within epsilon, and inside a task the join recurses on halves
of the two sequences, skipping halves whose boxes are farther apart. A pair is decided by its cosine in double precision.

Handling of odd input: vectors that are null, zero or hold null or non-finite components link with nothing; vectors of
different dimensions never link; equal vectors fold into one class before the join and count each other as links; a repeated
row counts as one more vector of its id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, materialize, scope

#: Leading axes that the grid order and the boxes use; numbers in the vectors of an interval, of which a task holds two.
AXES, NUMBERS = 8, 1 << 20
LEAF = 512
SAMPLE_PER_INTERVAL = 50
#: Numbers of the sample that the axes come from; any axes give the same links. Beyond so many intervals, fewer rows of each
#: are sampled for their bounds.
AXES_NUMBERS, MANY_INTERVALS, FEW_PER_INTERVAL = 1 << 21, 10_000, 8


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _axes(vectors: DataFrame, dim: int, rows: int) -> np.ndarray:
    """Principal axes, the leading one first, of about as many vectors as ``AXES_NUMBERS`` lets, at least one a dimension."""
    wanted = max(AXES_NUMBERS // dim, dim)
    share = min(1.0, wanted / max(1, rows))
    chosen = vectors.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else vectors
    sample = chosen.select("v").limit(2 * wanted).toArrow()["v"].to_pylist()
    u = _unit(sample) if sample else np.eye(dim)
    u = u - u.mean(0)
    return np.ascontiguousarray(np.linalg.eigh(u.T @ u)[1][:, ::-1])


def _to_bytes(batches):
    for batch in batches:
        rows = [np.array(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["id", "n", "v"])


def _cells(p: np.ndarray, epsilon: float) -> np.ndarray:
    """The grid order as one integer: 8 bits of cell number an axis, the leading axis first."""
    c = np.clip(np.floor(p[:, :AXES] / epsilon) + 128, 0, 255).astype(np.uint64)
    key = np.zeros(len(p), np.uint64)
    for j in range(c.shape[1]):
        key |= c[:, j] << np.uint64(8 * (7 - j))
    return key ^ np.uint64(1 << 63)


def _place(axes: np.ndarray, epsilon: float, splits):
    """Rows with their grid key, interval and leading coordinates; ``splits`` are sorted pairs (key, id)."""
    keys, firsts = (np.array([s[k] for s in splits], np.int64) for k in (0, 1))

    def run(batches):
        for batch in batches:
            p = _unit(batch.column(2).to_pylist()) @ axes if batch.num_rows else np.empty((0, len(axes)))
            key, ids = _cells(p, epsilon).view(np.int64), batch.column(0).to_numpy()
            at = np.searchsorted(keys, key, "left")
            for r in np.flatnonzero(at < np.searchsorted(keys, key, "right")):  # a split has this key: its id decides
                while at[r] < len(keys) and keys[at[r]] == key[r] and ids[r] >= firsts[at[r]]:
                    at[r] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(key), pa.array(at), pa.array(list(p[:, :AXES]), pa.list_(pa.float64()))], ["id", "n", "v", "key", "interval", "p"])

    return run


def _partners(placed: DataFrame, epsilon: float) -> DataFrame:
    """Rows (interval, pi, pj): the pairs pi <= pj of intervals whose boxes come within ``epsilon``, listed at both.

    Boxes meet by the cells that they span on the first axis, one cell more on one side; the distance of the whole boxes
    decides.
    """
    axes = placed.select(F.size("p").alias("n")).first()["n"]
    box = placed.groupBy("interval").agg(*[f(F.col("p")[k]).alias(f"{name}{k}") for k in range(axes) for f, name in ((F.min, "lo"), (F.max, "hi"))])
    box = materialize(box)
    cell = lambda c: F.floor(F.col(c) / epsilon)
    left = box.select(F.col("interval").alias("pi"), *[F.col(f"{s}{k}").alias(f"a{s}{k}") for k in range(axes) for s in ("lo", "hi")], F.explode(F.sequence(cell("lo0"), cell("hi0"))).alias("cell"))
    right = box.select(F.col("interval").alias("pj"), *[F.col(f"{s}{k}") for k in range(axes) for s in ("lo", "hi")], F.explode(F.sequence(cell("lo0") - 1, cell("hi0") + 1)).alias("cell"))
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"alo{k}") - F.col(f"hi{k}"), F.col(f"lo{k}") - F.col(f"ahi{k}")), F.lit(2)) for k in range(axes))
    near = left.join(right, "cell").where((F.col("pi") <= F.col("pj")) & (gap <= (epsilon + 1e-9) ** 2)).select("pi", "pj").distinct()
    return near.select(F.explode(F.array_distinct(F.array("pi", "pj"))).alias("interval"), "pi", "pj")


def _gap(lo_a, hi_a, lo_b, hi_b) -> float:
    d = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(np.sqrt((d * d).sum()))


def _join_pair(axes: np.ndarray, epsilon: float, cosine: float):
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["interval", "key", "id"], kind="stable")
        ids, n, side = pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["interval"].to_numpy()
        u = _unit(pdf["v"].tolist())
        p, u32 = (u @ axes).astype(np.float64), u.astype(np.float32)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        same = pdf["pi"].iat[0] == pdf["pj"].iat[0]
        half = len(ids) if same else int(np.searchsorted(side, side[-1]))

        def unite(a, b):
            while True:
                la, lb = label[a], label[b]
                differ = la != lb
                if not differ.any():
                    return
                a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while (label[label] != label).any():
                    label[:] = label[label]

        def go(a0, a1, b0, b1):
            if _gap(p[a0:a1].min(0), p[a0:a1].max(0), p[b0:b1].min(0), p[b0:b1].max(0)) > epsilon + 1e-9:
                return
            if a1 - a0 > LEAF or b1 - b0 > LEAF:
                if (a0, a1) == (b0, b1):
                    m = (a0 + a1) // 2
                    go(a0, m, a0, m)
                    go(a0, m, m, a1)
                    go(m, a1, m, a1)
                elif a1 - a0 >= b1 - b0:
                    m = (a0 + a1) // 2
                    go(a0, m, b0, b1)
                    go(m, a1, b0, b1)
                else:
                    m = (b0 + b1) // 2
                    go(a0, a1, b0, m)
                    go(a0, a1, m, b1)
                return
            r, c = np.nonzero(u32[a0:a1] @ u32[b0:b1].T >= cosine - 1e-4)
            r, c = r + a0, c + b0
            if a0 == b0:
                r, c = r[r < c], c[r < c]
            if len(r):
                sure = np.einsum("ij,ij->i", u[r], u[c]) >= cosine
                r, c = r[sure], c[sure]
                np.add.at(links, r, n[c])
                np.add.at(links, c, n[r])
                unite(r, c)

        if same:
            go(0, len(ids), 0, len(ids))
        elif 0 < half < len(ids):
            go(0, half, half, len(ids))
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids)
        hit = links > 0
        return pd.DataFrame({"id": ids[hit], "links": links[hit], "low": low[label][hit]})

    return join


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept): near-duplicates by cosine, and their connected components."""
    spark = vectors.sparkSession
    epsilon = math.sqrt(2 - 2 * cosine)
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) <= 1.7976931348623157e308)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    rows = rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v", F.size("v")).alias("h2"))
    classes = rows.where("v is not null and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    with scope(spark) as kept:
        of = _classes_of(materialize(classes), epsilon, cosine)
        kept.append(of)
    out = rows.select("id", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), "h2").join(of, ["h1", "h2"], "left")
    comp = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (comp == F.col("id")).alias("kept"))


def _classes_of(classes: DataFrame, epsilon: float, cosine: float) -> DataFrame:
    """(h1, h2, n_links, c) of each class of equal vectors: links to other vectors, and the smallest id of its component."""
    spark, found = classes.sparkSession, None
    for (dim,) in classes.select(F.size("v").alias("d")).distinct().collect():
        of_dim = classes.where(F.size("v") == dim).select(F.col("rep").alias("id"), "v", "n").mapInArrow(_to_bytes, "id long, n long, v binary")
        rows_of = of_dim.count()
        axes = _axes(of_dim, dim, rows_of)
        count = math.ceil(rows_of * dim / NUMBERS)
        splits: list[tuple[int, int]] = []
        if count > 1:
            share = min(1.0, count * (SAMPLE_PER_INTERVAL if count <= MANY_INTERVALS else FEW_PER_INTERVAL) / rows_of)
            picked = of_dim.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
            keyed = picked.mapInArrow(_place(axes, epsilon, []), "id long, n long, v binary, key long, interval long, p array<double>").select("key", "id").toArrow()
            keys, ids = keyed["key"].to_numpy(), keyed["id"].to_numpy()
            order = np.lexsort((ids, keys))
            cut = order[[len(order) * k // count for k in range(1, count)]] if len(order) else []
            splits = sorted({(int(keys[i]), int(ids[i])) for i in cut})
        placed = materialize(of_dim.mapInArrow(_place(axes, epsilon, splits), "id long, n long, v binary, key long, interval long, p array<double>"))
        dealt = placed.select("id", "n", "v", "key", "interval").join(_partners(placed, epsilon), "interval")
        # the pairs of intervals bound each group to two intervals
        part = dealt.groupBy("pi", "pj").applyInPandas(_join_pair(axes, epsilon, cosine), "id long, links long, low long")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "id long, links long, low long")
    found = materialize(found)
    groups = components(found.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = classes.select("h1", "h2", "n", F.col("rep").alias("id")).join(totals, "id", "left").join(groups, "id", "left")
    return materialize(of.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("c")))
