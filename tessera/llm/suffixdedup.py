"""Repeated byte strings across a corpus, by distributed prefix doubling over sampled positions.

Sorting every suffix would rank every byte. Here positions are chosen by content: each window of 100 bytes is owned by the
smallest of its 37-byte window hashes (a rule that looks at the window's bytes only, so equal windows are owned alike), and
the windows of one owner, at most 64, are a stretch. A stretch's first rank is that of its owner's 37 bytes. Then, round by
round, Spark sorts rows by rank; what is alone with its rank leaves, for no window of it comes again; of the rows that are
equal over their whole stretch all but the first are repeats; the others are cut in half, and each half is ranked again by
the pair of its rank and the rank of the bytes that all its windows share next to it: 32, then 16, 8, 4, 2 and 1 bytes, so
the ranked depth grows from 37 over 69, 85, 93, 97 and 99 to the threshold of 100. Ranks are hash names of 64 bits, with a
second name of 64 bits beside them where equality decides.

Tasks fold what they hold before each shuffle, so a string adds at most a row a task, however many documents share it. Where
very many different stretches of one task share a rank (the border of a passage that is everywhere), they are dealt by their
content instead of their rank, and a mark tells the rank's own task that it is not alone. The sorted rows are compared in
passing: no task holds a group.

Handling of odd input: a null or empty text has no bytes and loses none; texts under 100 bytes lose none; very long texts
are hashed in overlapping pieces and joined whole; rows with a null id are left out; the rows of one id count as one
document, with the smallest of their texts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import RANK_ROWS, materialize, one_row_per_id, release
from tessera.llm.hashing import CHUNK, U, all_windows, mix, prefix, row_hashes, windows

LENGTH, SPAN = 100, 64
SEED = LENGTH - SPAN + 1
_POS_MASK = U((1 << 21) - 1)
#: Rows that a map task holds before it folds and sends them on.
HELD = 1_000_000
#: Different stretches of one rank among them beyond which they are dealt by content.
HOT = 1_000
NEW, REPEAT, MARK, DEALT = range(4)
_SCHEMA = "core long, uni long, alt long, doc long, pos long, m int, left binary, right binary"
_NAMES = ["core", "uni", "alt", "doc", "pos", "m", "left", "right"]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w-long window, by block-wise running minima from both ends."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(y, 1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def runs(data: bytes):
    """(owner's rank, stretch's rank, owner, least and most bytes before it) of each stretch, as arrays."""
    out = []
    for base in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK + LENGTH - 1, len(data) - base), base)
        p = prefix(b)
        seeds = all_windows(p, SEED)
        owner = (_sliding_min((seeds & ~_POS_MASK) | np.arange(len(seeds), dtype=np.uint64), SPAN) & _POS_MASK).astype(np.int64)
        cut = np.flatnonzero(owner[1:] != owner[:-1])
        first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(owner) - 1]])
        at = owner[first]
        out.append((seeds[at], windows(p, first, last + LENGTH) + (last - first).astype(np.uint64), at + base, at - last, at - first))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 3


def _bytes(x: np.ndarray | None, n: int) -> pa.Array:
    """A byte matrix as a column of binary values; none for null values."""
    if x is None:
        return pa.nulls(n, pa.binary())
    at = np.arange(n + 1, dtype=np.int32) * np.int32(x.shape[1])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    """The binary values of one width of a column without nulls."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]].reshape(n, -1) if n else np.empty((0, 0), np.uint8)


def _batch(core, uni, alt, doc, pos, m, left=None, right=None) -> pa.RecordBatch:
    long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays([long(core), long(uni), long(alt), pa.array(doc), pa.array(pos), pa.array(m.astype(np.int32)), _bytes(left, len(doc)), _bytes(right, len(doc))], _NAMES)


def _fold(core, uni, alt, doc, pos, lo, hi, left=None, right=None):
    """The rows of a task, ordered: the repeats among them without bytes, the rest, and marks of ranks that are dealt by content."""
    order = np.lexsort((pos, doc, uni, core))
    core, uni, alt, doc, pos, m = (x[order] for x in (core, uni, alt, doc, pos, lo | hi << 8))
    same_core = np.concatenate([[False], core[1:] == core[:-1]])
    same = same_core & np.concatenate([[False], uni[1:] == uni[:-1]])
    yield _batch(*(x[same] for x in (core, uni, alt, doc, pos)), m[same] | REPEAT << 16)
    group = np.cumsum(~same_core) - 1
    hot = np.bincount(group[~same], minlength=1)[group] > HOT
    m = np.where(hot, m | DEALT << 16, m)
    yield _batch(*(x[~same] for x in (core, uni, alt, doc, pos, m)), *(None if x is None else x[order[~same]] for x in (left, right)))
    mark = hot & ~same_core
    if mark.any():
        none = np.zeros(mark.sum(), np.int64)
        yield _batch(core[mark], none.view(np.uint64), none.view(np.uint64), none, none, none + (MARK << 16))


def _sample(batches):
    """The stretches of whole texts."""
    held, n = [], 0

    def flush():
        core, uni, pos, lo, hi, doc = (np.concatenate(c) for c in zip(*held, strict=True))
        return _fold(core, uni, core, doc, pos, lo, hi)

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            cols = runs((text.as_py() or "").encode("utf-8", "surrogatepass"))
            if len(cols[0]):
                held.append((*cols, np.full(len(cols[0]), i, np.int64)))
                n += len(cols[0])
            if n > HELD:
                yield from flush()
                held, n = [], 0
    if held:
        yield from flush()


def _rank(batches):
    """Rows sorted by (core, uni, doc, pos), compared in passing: repeats, and the first rows of stretches that share their rank.

    A row that is the only one of its rank so far waits for the next of it.
    """
    before, rows, waiting = (None, None), 0, None  # the last row's core and uni, different stretches of its core (2 at most)
    for batch in batches:
        known = batch.column(5).to_numpy() >> 16 == REPEAT
        if known.any():
            yield batch.filter(pa.array(known))
            batch = batch.filter(pa.array(~known))
        if not batch.num_rows:
            continue
        core, uni, m = (batch.column(k).to_numpy() for k in (0, 1, 5))
        kind = m >> 16
        same_core = np.concatenate([[core[0] == before[0]], core[1:] == core[:-1]])
        same = same_core & np.concatenate([[uni[0] == before[1]], uni[1:] == uni[:-1]])
        group = np.cumsum(~same_core)  # 0 goes on from the batch before
        many = np.bincount(group, ~same, minlength=group[-1] + 1)
        many[0] += rows
        if waiting is not None and same_core[0] and many[0] >= 2:
            yield waiting
            waiting = None
        repeat = same & (kind != MARK)
        if repeat.any():
            none = pa.nulls(int(repeat.sum()), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(pa.array(repeat)) for k in range(5)), pa.array((m[repeat] & 0xFFFF | REPEAT << 16).astype(np.int32)), none, none], _NAMES)
        yield batch.filter(pa.array(~same & (kind != MARK) & ((many[group] >= 2) | (kind == DEALT))))
        before, rows = (core[-1], uni[-1]), min(2, int(many[group[-1]]))
        if group[-1] > 0:
            waiting = None
        first = np.flatnonzero(~same & (group == group[-1]))
        if rows == 1 and len(first) and kind[first[0]] == NEW:
            waiting = batch.slice(int(first[0]), 1)


def _halves(core, alt, doc, pos, lo, hi, left, right, size: int):
    """Each row's stretch of at most ``size`` windows cut in two, ranked by the pair of its rank and its next bytes.

    ``left`` and ``right`` hold size - 1 bytes beside the ranked ones, zero beyond what the row's windows cover. The windows
    that start nearer to the owner share the next bytes on the right, the others those on the left.
    """
    half, base = size // 2, hi // size * size
    near, far = lo - base < half, hi - base >= half
    column = np.arange(half - 1)
    h, low = np.minimum(hi, base + half - 1)[near], np.maximum(lo, base + half)[far]
    near_left = np.where(half - 1 - column <= (h - base[near])[:, None], left[near][:, half:], 0).astype(np.uint8)
    far_right = np.where(column < (base[far] + size - 1 - low)[:, None], right[far][:, : half - 1], 0).astype(np.uint8)
    out = []
    for side, mine, low_, high_, step, l, r in ((1, near, lo[near], h, right[near][:, :half], near_left, right[near][:, half:]), (2, far, low, hi[far], left[far][:, half - 1 :], left[far][:, : half - 1], far_right)):
        c = mix(mix(core[mine] + U(side)) + row_hashes(step))
        a = mix(mix(alt[mine] + U(side)) + row_hashes(step, 1))
        uni = mix(a + mix(row_hashes(l, 1) * U(3) + row_hashes(r) * U(5) + (low_ | high_ << 8).astype(np.uint64)))
        out.append((c, uni, a, doc[mine], pos[mine], low_, high_, l, r))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _context(batches):
    """Texts with their open stretches (core, pos, m) -> their halves."""
    held, n = [], 0

    def flush():
        return _fold(*_halves(*(np.concatenate(c) for c in zip(*held, strict=True)), SPAN))

    back, ahead, own = np.arange(SPAN - 1) - (SPAN - 1), np.arange(SPAN - 1) + SEED, np.arange(SEED)
    for batch in batches:
        for i, text, cores, places, ms in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3, 4)), strict=True):
            b = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
            core, pos, m = (x.values.to_numpy() for x in (cores, places, ms))
            lo, hi = (m & 255).astype(np.int64), (m >> 8 & 255).astype(np.int64)
            at = pos[:, None]
            left = np.where(-back <= hi[:, None], b[np.maximum(at + back, 0)], 0).astype(np.uint8)
            right = np.where(ahead < LENGTH - lo[:, None], b[np.minimum(at + ahead, len(b) - 1)], 0).astype(np.uint8)
            held.append((core.view(np.uint64), row_hashes(b[at + own], 1), np.full(len(pos), i, np.int64), pos, lo, hi, left, right))
            n += len(pos)
        if n > HELD // 4:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def _deal(size: int):
    """Open rows of at most ``size`` windows -> their halves."""

    def run(batches):
        held, n = [], 0

        def flush():
            return _fold(*_halves(*(np.concatenate(c) for c in zip(*held, strict=True)), size))

        for batch in batches:
            if batch.num_rows:
                core, alt, doc, pos, m = (batch.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
                m = m.astype(np.int64)
                held.append((core.view(np.uint64), alt.view(np.uint64), doc, pos, m & 255, m >> 8 & 255, _matrix(batch.column(6)), _matrix(batch.column(7))))
                n += batch.num_rows
            if n > HELD // 4:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return run


def _ranked(rows: DataFrame) -> DataFrame:
    kind = F.shiftright("m", 16)
    key = F.when(kind == REPEAT, F.xxhash64("doc", "pos")).when(kind == DEALT, F.xxhash64("core", "uni")).otherwise(F.col("core"))
    return materialize(rows.repartition(key).sortWithinPartitions("core", "uni", "doc", "pos").mapInArrow(_rank, _SCHEMA), batch_rows=RANK_ROWS)


def _cut(batches):
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            starts = stops = np.empty(0, np.int64)
            if spans.is_valid:
                first = np.sort(spans.values.to_numpy())
                stop = np.maximum.accumulate((first >> 8) + (first & 255) + LENGTH)
                first >>= 8
                new = np.concatenate([[True], first[1:] > stop[:-1]])
                starts, stops = first[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
            kept = b"".join(data[a:z] for a, z in zip([0, *stops.tolist()], [*starts.tolist(), len(data)], strict=True))
            rows.append((len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), starts, stops))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops"])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_removed, n_spans, kept_sha256, starts, stops): bytes in 100-byte strings that start earlier.

    The texts are dealt by id twice, for the bytes beside open stretches and for the cut; all else that moves are ranks,
    places and those bytes.
    """
    docs = one_row_per_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null"))
    is_open = F.shiftright("m", 16) != REPEAT
    rounds = [_ranked(docs.mapInArrow(_sample, _SCHEMA))]
    lists = rounds[0].where(is_open).groupBy(F.col("doc").alias("id")).agg(*[F.collect_list(x).alias(x) for x in ("core", "pos", "m")])
    rounds.append(_ranked(docs.join(lists, "id").mapInArrow(_context, _SCHEMA)))
    size = SPAN // 2
    while size > 1 and not rounds[-1].where(is_open).isEmpty():
        rounds.append(_ranked(rounds[-1].where(is_open).mapInArrow(_deal(size), _SCHEMA)))
        size //= 2
    low, high = F.col("m").bitwiseAND(255), F.shiftright("m", 8).bitwiseAND(255)
    span = (F.col("pos") - high) * 256 + high - low
    found = [r.where(~is_open).select(F.col("doc").alias("id"), span.alias("span")) for r in rounds]
    repeats = found[0]
    for r in found[1:]:
        repeats = repeats.union(r)
    removed = materialize(repeats.groupBy("id").agg(F.collect_list("span").alias("spans")))
    release(*rounds)
    out = docs.join(removed, "id", "left").mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>")
    return out.withColumnRenamed("id", id_col)
