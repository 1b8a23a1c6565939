"""Ranked lexical search over dual-sorted wavelet trees, one a shard.

A shard is a run of documents of one task. Its postings stand term by term, within a term by falling impact, and the
sequence of their document numbers is kept as a wavelet tree: level by level one bit of the number, the sequence stably
parted by it. A term is a range of the sequence, and a node of the tree, a range of documents, holds each term's postings for
those documents, still by falling impact: the first one bounds them all. A search keeps the nodes of an item by the sum of its
terms' bounds and opens the best first; the bound of a leaf is the document's score. It ends when no open node can reach the
k-th best score, which a task carries from shard to shard.

Sizes: a shard ends after ``SHARD_DOCS`` documents or ``SHARD_TERMS`` postings, whichever comes first, so a
tree's memory is bounded by these or by one document. Every document is indexed; the search is exact.

Handling of odd input: null and empty texts and texts without terms are indexed nowhere and not counted; rows of one id are
documents of their own, ranked one after the other; rows with a null id count for the statistics and are never returned; an
item without text or without terms has no result; rows of one item id are one item, with the smallest of their texts, and
those with a null id are left out; equal scores go by ascending id; very long texts are read whole; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

SHARD_DOCS, SHARD_TERMS = 4096, 1 << 19
#: Nodes that a search opens at once.
WIDTH = 48
#: Items that one pass over the index searches for; more go in further passes.
ITEMS = 4096
#: Parts of an item's candidates that are cut to k before all of them meet.
SALT = 16
_SPACES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Terms by SQL: what is not between them.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all beyond ASCII, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split()


def impact(tf: np.ndarray, n: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    """The integer weight of ``tf`` occurrences in a document of ``n`` terms, without the term's own weight."""
    m = 75 + (25 * n * docs) // tokens
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def term_weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Tree:
    """A wavelet tree over document numbers, its sequence given at the root; ranks and impacts are kept for each level."""

    def __init__(self, n_docs: int, bits: np.ndarray, impacts: np.ndarray):
        self.levels, n = len(bits), len(impacts)
        self.ones = np.zeros((self.levels, n + 1), np.int32)  # ones before a position
        self.zeros = np.zeros(self.levels, np.int64)
        self.impacts = np.empty((self.levels + 1, n), np.int32)
        self.impacts[0] = impacts
        for level, row in enumerate(bits):
            one = row.astype(bool)
            np.cumsum(one, out=self.ones[level, 1:])
            self.zeros[level] = n - self.ones[level, n]
            last, part = self.impacts[level], int(self.zeros[level])
            self.impacts[level + 1, :part], self.impacts[level + 1, part:] = last[~one], last[one]

    @staticmethod
    def sequence_bits(sequence: np.ndarray, levels: int) -> np.ndarray:
        """The bits of each level, the highest first, the sequence stably parted after each."""
        out = np.zeros((levels, len(sequence)), np.uint8)
        for level in range(levels):
            one = (sequence >> (levels - 1 - level)) & 1
            out[level] = one
            one = one.astype(bool)
            sequence = np.concatenate([sequence[~one], sequence[one]])
        return out

    def search(self, first: np.ndarray, last: np.ndarray, weights: np.ndarray, k: int, least: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and scores of all that may be among the k best: those with a score of ``least`` and above 0.

        ``first``, ``last``: a range of the sequence for each term. ``least`` rises to the k-th best score found so far.
        """
        level, node = np.zeros(1, np.int64), np.zeros(1, np.int64)
        lo, hi = first[None, :], last[None, :]
        bound = self._bounds(level, lo, hi, weights)
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        least = max(least, 1)
        while True:
            open_ = bound >= least
            if not open_.all():
                level, node, lo, hi, bound = level[open_], node[open_], lo[open_], hi[open_], bound[open_]
            if not len(bound):
                return docs, scores
            if len(bound) > width:
                best = np.argpartition(-bound, width)
                take, rest = best[:width], best[width:]
            else:
                take, rest = np.arange(len(bound)), np.empty(0, np.int64)
            # the children of the best nodes; a child at the last level is a document, its bound its score
            at = level[take][:, None]
            ones_lo, ones_hi = self.ones[at, lo[take]], self.ones[at, hi[take]]
            zero = self.zeros[at]
            child_lo = np.concatenate([lo[take] - ones_lo, zero + ones_lo])
            child_hi = np.concatenate([hi[take] - ones_hi, zero + ones_hi])
            child_level = np.concatenate([level[take], level[take]]) + 1
            child_node = np.concatenate([node[take] * 2, node[take] * 2 + 1])
            child_bound = self._bounds(child_level, child_lo, child_hi, weights)
            leaf = (child_level == self.levels) & (child_bound >= least)
            if leaf.any():
                docs, scores = np.concatenate([docs, child_node[leaf]]), np.concatenate([scores, child_bound[leaf]])
                if len(scores) >= k:
                    least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    good = scores >= least
                    docs, scores = docs[good], scores[good]
            inner = child_level < self.levels
            level, node = np.concatenate([level[rest], child_level[inner]]), np.concatenate([node[rest], child_node[inner]])
            lo, hi = np.concatenate([lo[rest], child_lo[inner]]), np.concatenate([hi[rest], child_hi[inner]])
            bound = np.concatenate([bound[rest], child_bound[inner]])

    def _bounds(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sum of weight times first impact over the terms with a posting in the node."""
        first = self.impacts[level[:, None], np.minimum(lo, self.impacts.shape[1] - 1)]
        return np.where(lo < hi, first, 0).astype(np.int64) @ weights


_INDEX = "doc_ids array<long>, terms array<binary>, starts binary, bits binary, impacts binary"


def _indexer(docs: int, tokens: int, shard_docs: int, shard_terms: int):
    """Shards of a task's documents (id, text)."""

    def build(ids, counts, lengths):
        names: dict[bytes, int] = {}
        number = [np.fromiter((names.setdefault(t, len(names)) for t in c), np.int64, len(c)) for c in counts]
        term, doc = np.concatenate(number), np.repeat(np.arange(len(ids)), [len(c) for c in counts])
        tf = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts])
        weight = impact(tf, np.asarray(lengths, np.int64)[doc], docs, tokens)
        order = np.lexsort((doc, -weight, term))
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
        levels = max(1, (len(ids) - 1).bit_length())
        bits = Tree.sequence_bits(doc[order], levels)
        return ids, list(names), starts.astype("<i4").tobytes(), np.packbits(bits, axis=1).tobytes(), weight[order].astype("<i4").tobytes()

    def run(batches):
        ids, counts, lengths, size = [], [], [], 0

        def shard():
            row = build(ids, counts, lengths)
            types = [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["doc_ids", "terms", "starts", "bits", "impacts"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                c = Counter(words)
                ids.append(i), counts.append(c), lengths.append(len(words))
                size += len(c)
                if len(ids) >= shard_docs or size >= shard_terms:
                    yield shard()
                    ids, counts, lengths, size = [], [], [], 0
        if ids:
            yield shard()

    return run


def _counter(batches):
    """Documents with a term, and all their terms, of a task."""
    docs = tokens = 0
    for batch in batches:
        for text in batch.column(0):
            n = len(terms(text.as_py()))
            docs, tokens = docs + (n > 0), tokens + n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], ["docs", "tokens"])


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    got = docs.select(F.col(text_col).cast("string")).mapInArrow(_counter, "docs long, tokens long").agg(F.sum("docs"), F.sum("tokens")).first()
    return got[0] or 0, got[1] or 0


def build_index(docs: DataFrame, size: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """One row a shard, written to the shared folder: ids, terms, where their postings start, the tree's bits, the impacts."""
    return materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_indexer(*size, shard_docs, shard_terms), _INDEX))


def _ranges(batch, row: int, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For the wanted terms their ranges of the shard's sequence, empty where it lacks them."""
    at = pc.fill_null(pc.index_in(wanted, value_set=batch.column("terms")[row].values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.frombuffer(batch.column("starts")[row].as_py(), "<i4").astype(np.int64)
    return np.where(at >= 0, starts[at], 0), np.where(at >= 0, starts[at + 1 - (at < 0)], 0)


def _holders(wanted: list[bytes]):
    """Documents by wanted term, over the shards of a task."""

    def run(batches):
        total, names = np.zeros(len(wanted), np.int64), pa.array(wanted, pa.binary())
        for batch in batches:
            for row in range(batch.num_rows):
                lo, hi = _ranges(batch, row, names)
                total += hi - lo
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "df"])

    return run


def _searcher(wanted: list[bytes], items: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    """The k best documents of each item over the shards of a task; items: (id, numbers of its terms, their weights)."""

    def run(batches):
        names = pa.array(wanted, pa.binary())
        best = {item: (np.empty(0, np.int64), np.empty(0, np.int64)) for item, _, _ in items}
        for batch in batches:
            for row in range(batch.num_rows):
                lo, hi = _ranges(batch, row, names)
                ids = batch.column("doc_ids")[row].values
                known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                impacts = np.frombuffer(batch.column("impacts")[row].as_py(), "<i4")
                levels = max(1, (len(ids) - 1).bit_length())
                packed = np.frombuffer(batch.column("bits")[row].as_py(), np.uint8).reshape(levels, -1)
                tree = Tree(len(ids), np.unpackbits(packed, axis=1, count=len(impacts)), impacts)
                for item, at, weights in items:
                    here = hi[at] > lo[at]
                    if not here.any():
                        continue
                    found, scores = best[item]
                    # rows without an id can't be returned, so they may not raise the bar either
                    more = k + int((~known).sum())
                    docs, got = tree.search(lo[at][here], hi[at][here], weights[here], more, int(scores.min()) if len(scores) >= k else 1)
                    docs, got = docs[known[docs]], got[known[docs]]
                    if len(docs):
                        found, scores = np.concatenate([found, ids[docs]]), np.concatenate([scores, got])
                        top = np.lexsort((found, -scores))[:k]
                        best[item] = found[top], scores[top]
        for item, (found, scores) in best.items():
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item), pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    return run


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    one = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").groupBy("id").agg(F.min("text").alias("text"))
    return materialize(one)


def search(index: DataFrame, items: DataFrame, size: tuple[int, int], k: int = 20, id_col: str = "item_id", text_col: str = "text", at_once: int = ITEMS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k best documents of each item, by score, then by id.

    Items are read by the driver about ``at_once`` at a time, and each such pass sends its terms and weights to all shards.
    """
    best = None
    once = _items(items, id_col, text_col)
    passes = max(1, math.ceil(once.count() / at_once))
    for p in range(passes):
        part = once.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p) if passes > 1 else once
        asked = {r.id: Counter(terms(r.text)) for r in part.toLocalIterator()}
        wanted = sorted({t for c in asked.values() for t in c})
        number = {t: n for n, t in enumerate(wanted)}
        df = dict(index.select("terms", "starts").mapInArrow(_holders(wanted), "term int, df long").groupBy("term").agg(F.sum("df")).collect())
        weight = [term_weight(df.get(n, 0), size[0]) for n in range(len(wanted))]
        queries = []
        for item, c in sorted(asked.items()):
            at = np.array([number[t] for t in c], np.int64)
            queries.append((item, at, np.array([weight[number[t]] * times for t, times in c.items()], np.int64)))
        found = index.mapInArrow(_searcher(wanted, queries, k), "item_id long, doc_id long, score long")
        best = found if best is None else best.union(found)
    order = [F.desc("score"), F.asc("doc_id")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return few.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
