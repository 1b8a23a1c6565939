"""Importance resampling towards a target distribution over hashed word features, drawn by Gumbel noise.

A text's bucket array comes from higher-order functions, and its weight folds that array over a literal array of gains, one
entry a bucket: no row is exploded for scoring, and only totals by bucket move. The draw needs no order of all rows: a
histogram of the scores finds the lowest that can still be drawn, and only the rows from there on are sorted, by ranges.

Handling of odd input: null and empty texts have no features, the weight 0, and are not drawn; ties of the score go to the
smaller id, and repeated rows, each a document of its own, get ranks one after the other; a row with a null id has a weight
but neither score nor rank and is not counted for the draw, though its words count; very long texts are read whole; empty
tables give an empty result, an empty target gives gains that only follow the corpus; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between the words of a text whose A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bins of the histogram of scores that the driver reads.
BINS = 4096


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def features(ws: Column, longest: int = LONGEST_RUN) -> Column:
    """All runs of 1 to ``longest`` consecutive words, repeats included. ``ws`` should be a column, as it is named often."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(ws) - n + 1)
        return F.when(F.size(ws) >= n, F.transform(starts, lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return ws if longest == 1 else F.concat(ws, *map(runs, range(2, longest + 1)))


def bucket_array(ws: Column, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> Column:
    return F.transform(features(ws, longest), lambda f: (F.crc32(f) % buckets).cast("int"))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> dict[int, int]:
    """Features by bucket: each task adds up its own, so that at most one row a bucket and task moves."""
    each = docs.select(words(F.col(text_col)).alias("ws")).select(F.explode(bucket_array(F.col("ws"), buckets, longest)).alias("bucket"))
    return dict(each.groupBy("bucket").count().toLocalIterator())


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * log ratio) of the smoothed shares of target and corpus, for each bucket."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((corpus.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def _literal(numbers: list[int]) -> Column:
    """An array literal: the split of a constant is folded once, when the plan is made."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) that the key alone decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """Rows (id_col, n_words, n_features, weight, score) of all documents."""
    held = docs.select(F.col(id_col).cast("long").alias(id_col), words(F.col(text_col)).alias("ws"))
    held = held.select(id_col, F.size("ws").cast("long").alias("n_words"), bucket_array(F.col("ws"), len(gain), longest).alias("bs"))
    table = _literal(gain)
    held = held.select(id_col, "n_words", F.size("bs").cast("long").alias("n_features"), F.aggregate("bs", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1)).alias("weight"))
    return held.withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id") -> DataFrame:
    """``scored`` with the rank of the drawn rows, null for the others. ``scored`` must be a written table."""
    in_draw = F.col(id_col).isNotNull() & (F.col("n_words") >= least_words)
    pool = scored.where(in_draw)
    n, low, high = pool.agg(F.count("*"), F.min("score"), F.max("score")).first()
    k = percent * n // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    width = (high - low) // BINS + 1
    bins = pool.groupBy(F.floor((F.col("score") - low) / width).alias("bin")).count().collect()
    above, cut = 0, low
    for b, count in sorted(map(tuple, bins), reverse=True):
        above, cut = above + count, low + b * width
        if above >= k:
            break
    order = [F.desc("score"), F.asc(id_col), F.asc("n_features"), F.asc("weight")]
    head = pool.where(F.col("score") >= cut).repartitionByRange(*order).sortWithinPartitions(*order)
    head = materialize(head.withColumn("place", F.monotonically_increasing_id()))  # the partition's number, then 33 bits of the row's
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = dict(head.groupBy(part.cast("int")).count().collect())
    before = [0]
    for p in range(max(sizes)):
        before.append(before[-1] + sizes.get(p, 0))
    rank = F.element_at(_literal(before), part.cast("int") + 1) + at + 1
    ranked = head.withColumn("rank", F.when(rank <= k, rank)).drop("place")
    return ranked.unionByName(scored.where(~in_draw | (F.col("score") < cut)).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """Rows (id_col, n_words, n_features, weight, score, rank): the documents nearest to the ``target`` texts are drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, "text", buckets, longest), buckets)
    return draw(materialize(score(docs, gain, id_col, text_col, longest, seed)), percent, least_words, id_col)
