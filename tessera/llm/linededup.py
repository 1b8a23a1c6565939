"""Line dedup: two Bloom filters, for once-seen and twice-seen keys, then exact confirmation of the suspects only.

Handling of odd input: a null or empty text is one empty line and is never dropped; very long texts are read whole; rows
with a null id can hold no vote and keep their lines; repeated rows of one id count as one document for the votes and each
come back; an empty table gives an empty result; extra columns only travel when named in ``carry``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release

SEGMENT_BITS = 1 << 20
BITS_PER_LINE = 16
#: Bound on the filter that is sent to the executors. Beyond it only false suspects grow, never the result.
MAX_FILTER_MB = 32
#: Repeated keys up to which they go to the texts (24 bytes each); beyond it the texts are joined to their drops.
BROADCAST_KEYS = 2_000_000
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    key = line.encode("utf-8", "surrogatepass").strip(_STRIP).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return key


def _doc_hashes(text: str | None, min_chars: int) -> set[int]:
    keys = {k for line in (text or "").split("\n") if (k := line_key(line, min_chars)) is not None}
    return {xxhash.xxh3_128_intdigest(k) for k in keys}


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and two bit positions in it, from 64 bits of the key's hash."""
    return ((h >> np.uint64(44)) % np.uint64(segments)).astype(np.int64), (h & np.uint64(SEGMENT_BITS - 1)).astype(np.int64), ((h >> np.uint64(20)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)


def _low(hashes) -> np.ndarray:
    return np.fromiter((h & 0xFFFFFFFFFFFFFFFF for h in hashes), np.uint64)


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def _filters(segments: int, min_chars: int):
    """Per task and segment: the bits of keys seen, and of keys seen in two documents of the task."""

    def emit(parts):
        h = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        again = np.unique(h[1:][h[1:] == h[:-1]])
        seg, b1, b2 = _places(h, segments)
        seg2, c1, c2 = _places(again, segments)
        rows = []
        for s in np.unique(seg):
            once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
            once[b1[seg == s]] = once[b2[seg == s]] = True
            twice[c1[seg2 == s]] = twice[c2[seg2 == s]] = True
            rows.append((int(s), _pack(once), _pack(twice)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "once", "twice"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                h = _low(_doc_hashes(text.as_py(), min_chars))
                parts.append(h)
                held += len(h)
            if held > 4_000_000:
                yield emit(parts)
                parts, held = [], 0
        yield emit(parts)

    return run


def _merge(batches):
    """Filters sorted by segment -> one row a segment; a key of two tasks has its bits in both ``once`` filters."""
    at, once, twice = None, None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["segment", "twice"])
    for batch in batches:
        for s, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            a, b = _unpack(a), _unpack(b)
            if s != at:
                if at is not None:
                    yield done()
                at, once, twice = s, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if at is not None:
        yield done()


def _suspects(filters, segments: int, min_chars: int):
    def run(batches):
        table = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
        for s, d in filters.value.items():
            table[s] = _unpack(d)
        for batch in batches:
            ids, high, low = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None:
                    continue
                full = list(_doc_hashes(text.as_py(), min_chars))
                h = _low(full)
                seg, b1, b2 = _places(h, segments)
                hit = ((table[seg, b1 >> 3] >> (7 - (b1 & 7))) & (table[seg, b2 >> 3] >> (7 - (b2 & 7))) & 1).astype(bool)
                for k in np.flatnonzero(hit):
                    ids.append(i)
                    high.append(_halves(full[k])[0])
                low.append(h[hit])
            lows = np.concatenate(low).view(np.int64) if low else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(high, pa.int64()), pa.array(lows)], ["id", "h1", "h2"])

    return run


def _halves(h: int) -> tuple[int, int]:
    """A 128-bit hash as two signed longs."""
    high, low = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return high - (high >> 63 << 64), low - (low >> 63 << 64)


def _drop(min_chars: int, keepers=None):
    """Texts without the lines that are dropped: those of ``keepers`` (keys and who keeps each) or of the column of drops."""

    def run(batches):
        table = None if keepers is None else keepers.value
        for batch in batches:
            texts, lines, dropped = [], [], []
            for i, text, drops in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                rows = text.split("\n")
                lines.append(len(rows))
                gone = set()
                if drops.is_valid:
                    gone = {(d["h1"], d["h2"]) for d in drops.as_py()}
                    keys = [(k := line_key(r, min_chars)) and _halves(xxhash.xxh3_128_intdigest(k)) for r in rows] if gone else []
                elif table is not None and i is not None and len(text) >= min_chars:
                    keys = [(k := line_key(r, min_chars)) and _halves(xxhash.xxh3_128_intdigest(k)) for r in rows]
                    asked = list({k for k in keys if k is not None})
                    if asked and len(table[1]):
                        h1, h2 = (np.array(x, np.int64) for x in zip(*asked, strict=True))
                        at = np.minimum(np.searchsorted(table[1], h2), len(table[1]) - 1)
                        gone = {asked[j] for j in np.flatnonzero((table[1][at] == h2) & (table[0][at] == h1) & (table[2][at] != i))}
                if gone:
                    kept = [r for r, k in zip(rows, keys, strict=True) if k not in gone]
                    text = "\n".join(kept)
                    dropped.append(len(rows) - len(kept))
                else:
                    dropped.append(0)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), batch.column(3)], ["id", "text", "n_lines", "n_dropped", "rest"])

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, carry: tuple[str, ...] = (), max_filter_mb: int = MAX_FILTER_MB) -> DataFrame:
    """Rows (id_col, text_col, n_lines, n_dropped, *carry): lines whose key stands in ``min_docs`` documents go.

    A key is the line stripped of ASCII white space and lower-cased (A-Z). All its lines go but those of the largest id
    that holds it. The filters' size follows the number of lines, up to ``max_filter_mb``. The texts stay where they are: what
    goes to them is each repeated key with the id that keeps it, up to a checked count.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(carry)]).alias("rest"))
    n = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    segments = int(min(max(1, -(-n * BITS_PER_LINE // SEGMENT_BITS)), max_filter_mb * 8_388_608 // SEGMENT_BITS))
    parts = docs.select("text").mapInArrow(_filters(segments, min_chars), "segment long, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment long, twice binary")
    filters = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in merged.collect()})
    suspects = materialize(docs.select("id", "text").mapInArrow(_suspects(filters, segments, min_chars), "id long, h1 long, h2 long").distinct())
    filters.destroy()
    common = materialize(suspects.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n"))
    drops_type, shared = "array<struct<h1: long, h2: long>>", None
    # keys that share the lower half of their hash cannot be looked up by it; there are none below about 10^9 keys
    if common.count() <= BROADCAST_KEYS and common.groupBy("h2").count().where("count > 1").isEmpty():
        got = common.orderBy("h2").toArrow()
        shared = spark.sparkContext.broadcast([got.column(c).to_numpy() for c in ("h1", "h2", "keeper")])
        out = docs.select("id", "text", F.lit(None).cast(drops_type).alias("drops"), "rest")
    else:
        drops = suspects.join(common, ["h1", "h2"]).where("id <> keeper").groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))
        out = docs.join(materialize(drops), "id", "left").select("id", "text", "drops", "rest")
    release(suspects, common)
    kept = out.mapInArrow(_drop(min_chars, shared), f"id long, text string, n_lines long, n_dropped long, rest {docs.schema['rest'].dataType.simpleString()}")
    return kept.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_dropped", *[F.col(f"rest.x{i}").alias(c) for i, c in enumerate(carry)])
