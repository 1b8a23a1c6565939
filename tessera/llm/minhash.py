"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

Handling of odd input: null or empty texts and texts without words have an empty set, link with nothing and stay; rows
with a null id are left out; the rows of one id count as one document, with the smallest of their texts; very long texts are
read whole, in pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, components, materialize, one_row_per_id, scope
from tessera.llm.hashing import U, mix, shingles, word_hashes

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
_SHIFT = U(64 - BINS.bit_length() + 1)
_EDGES = np.append(np.arange(BINS, dtype=np.uint64) << _SHIFT, U(0xFFFFFFFFFFFFFFFF))
#: Bin that an empty bin borrows from, by attempt: the universal hash of the optimal densification.
_JUMPS = (mix(np.arange(BINS, dtype=np.uint64)[:, None] * U(1 << 20) + np.arange(1, 65, dtype=np.uint64)[None, :]) % U(BINS)).astype(np.int64)


def sketch(shingle_set: np.ndarray) -> np.ndarray:
    """128 minima of one permutation over a sorted set; an empty bin copies a full one, the same in all documents."""
    at = np.searchsorted(shingle_set, _EDGES)
    full = at[:-1] < at[1:]
    out = shingle_set[np.minimum(at[:-1], len(shingle_set) - 1)]
    if not full.all():
        reach = full[_JUMPS]
        source = _JUMPS[np.arange(BINS), reach.argmax(1)]
        source = np.where(reach.any(1), source, np.flatnonzero(full)[0])
        out = np.where(full, out, out[source])
    return out


def bands(shingle_set: np.ndarray) -> np.ndarray:
    s = sketch(shingle_set).reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        h = mix(h * U(0xD6E8FEB86659FD93) + s[:, r])
    return h


def _digest(shingle_set: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    with np.errstate(over="ignore"):
        a, b = np.add.reduce(mix(shingle_set + U(1))), np.bitwise_xor.reduce(mix(shingle_set * U(3) + U(7)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingles(word_hashes((text or "").encode("utf-8", "surrogatepass"))))


def _signatures(batches):
    for batch in batches:
        ids, rows = batch.column(0), []
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            rows.append((len(s), *(_digest(s) if len(s) else (0, 0)), bands(s).view(np.int64) if len(s) else None))
        yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["id", "n", "d1", "d2", "bands"])


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], ["id", "s"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets reach the similarity, decided on integers.

    The set of ``a`` travels with its pair; that of ``b``, of which many pairs may have the same, meets them where they are.
    """
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame | None, key: str, to: str) -> DataFrame:
    """``rows`` with the component of ``key`` so far."""
    if labels is None:
        return rows.withColumn(to, F.col(key))
    return rows.join(labels.select(F.col("id").alias(key), F.col("c").alias(to)), key, "left").withColumn(to, F.coalesce(to, key))


def _unite(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (id, c) after more ``links`` (a, b) between ids; ids without a link have no row."""
    ends = _labelled(_labelled(links, labels, "a", "ca"), labels, "b", "cb")
    merged = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct())
    if labels is None:
        return materialize(merged.withColumnRenamed("component_id", "c"))
    known = labels.union(merged.select("id", F.col("id").alias("c"))).distinct()
    return materialize(known.join(merged.select(F.col("id").alias("c"), "component_id"), "c", "left").select("id", F.coalesce("component_id", "c").alias("c")))


def prefix_pairs(sets: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b) of ``sets`` (id, s) across components that may reach the similarity: an exact prefix filter.

    Shingles are ordered by the number of sets that hold them. Two sets that reach the similarity share one of the rarest
    quarter of the larger and of the rarest seventh of the smaller (for 75 percent): else too few shingles are left. Most of
    these are in one set only, so sets that each have enough of their own meet nobody. How many shingles can still follow
    the shared one bounds the pairs further.
    """
    tokens = _labelled(sets.select("id", F.size("s").cast("long").alias("n"), "s"), labels, "id", "c").select("id", "n", "c", F.explode("s").alias("x"))
    common = tokens.join(sets.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("d")).where("d > 1"), "x")
    own, by = F.count("*").over(Window.partitionBy("id")), F.row_number().over(Window.partitionBy("id").orderBy("d", "x"))
    n, at = F.col("n"), F.col("n") - own + by - 1
    least = lambda whole, part: F.floor((whole * n + part - 1) / part).cast("long")  # noqa: E731  the ceiling of n * whole / part
    ranked = common.select("x", "id", "n", "c", at.alias("at"), (n - least(percent, 100)).alias("far"), (n - least(2 * percent, 100 + percent)).alias("near"))
    ranked = materialize(ranked.where("at <= far"))
    small = ranked.where("at <= near").select("x", *[F.col(k).alias(f"{k}_a") for k in ("id", "n", "c", "at")])
    large = ranked.select("x", *[F.col(k).alias(f"{k}_b") for k in ("id", "n", "c", "at")])
    a_first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    reach = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    may = a_first & (F.col("c_a") != F.col("c_b")) & (F.col("n_a") * 100 >= F.col("n_b") * percent) & (reach * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
    return small.join(large, "x").where(may).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept) by Jaccard similarity of 5-word shingle sets.

    Equal sets fold into their smallest id first. The hub of a band bucket is the member whose buckets are the fullest, so
    the middle of a group of copies; every other member is compared with it: edges grow with the members, not with their
    square. A member is first compared with the hub of most of its buckets, then with those that are not in its component
    by then. Links are decided on the full sets. The sets of buckets that still hold several components without their
    hub are compared by an exact prefix filter, so no link that could still join two components is lost.
    """
    spark = docs.sparkSession
    with scope(spark) as kept:
        docs = one_row_per_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null"))
        signed = materialize(docs.mapInArrow(_signatures, "id long, n long, d1 long, d2 long, bands array<long>"))
        reps = materialize(signed.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.first("bands").alias("bands")))
        labels = _linked(docs, reps, percent)
        whole = materialize(_labelled(reps.select("d1", "d2", F.col("rep").alias("id")), labels, "id", "component_id").select("d1", "d2", "component_id"))
        kept += [signed, whole]
    out = signed.select("id", "n", "d1", "d2").join(whole, ["d1", "d2"], "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), (comp == F.col("id")).alias("kept"))


def _linked(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame | None:
    """Labels (id, c) of the linked among ``reps`` (rep, n, bands); None without any. Steps with nothing to do are left out."""
    places = reps.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = materialize(places.join(shared, "bucket").select("bucket", "id", "n", (-F.sum("m").over(Window.partitionBy("id"))).alias("turn")))
    if members.isEmpty():
        return None
    wanted = materialize(members.select("id").distinct())
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = materialize(docs.join(wanted, "id", "left_semi").mapInArrow(_sets, "id long, s array<long>"))
    hubs = materialize(members.groupBy("bucket").agg(F.min_by(F.struct("id", "n"), F.struct("turn", "id")).alias("h")).select("bucket", F.col("h.id").alias("hub"), F.col("h.n").alias("hn")))
    close = (F.col("id") != F.col("hub")) & (F.least("n", "hn") * 100 >= F.greatest("n", "hn") * percent)
    stars = materialize(members.join(hubs, "bucket").where(close).groupBy("id", "hub").agg(F.count("*").alias("k")))
    first = materialize(_verify(stars.groupBy(F.col("id").alias("a")).agg(F.max_by("hub", F.struct("k", "hub")).alias("b")), sets, percent))
    labels = None if first.isEmpty() else _unite(None, first)
    others = _labelled(_labelled(stars.select(F.col("id").alias("a"), F.col("hub").alias("b")), labels, "a", "ca"), labels, "b", "cb").where("ca <> cb")
    second = materialize(_verify(others.select("a", "b"), sets, percent))
    labels = labels if second.isEmpty() else _unite(labels, second)
    spokes = materialize(_labelled(members.join(hubs, "bucket").where("id <> hub").select("bucket", "id"), labels, "id", "c"))
    mixed = spokes.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("bucket")
    left = materialize(sets.join(spokes.join(mixed, "bucket", "left_semi").select("id").distinct(), "id", "left_semi"))
    if left.isEmpty():
        return labels
    third = materialize(_verify(materialize(prefix_pairs(left, labels, percent)), sets, percent))
    return labels if third.isEmpty() else _unite(labels, third)
