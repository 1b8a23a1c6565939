"""Offset-mapped token counts: a document is encoded once, and its tokens are joined to its sections by character span.

Sections are the lines of a text, each with the line end that closes it, or the caller's own: a column of character spans
(start, stop), which ``joined_fields`` makes for documents of several fields. A token that crosses a boundary goes by
``rule``: "first" (the section of its first character, the default), "last" (of its last character) or "most" (of most of
its bytes, ties to the earlier section). What no span holds is section -1.

Handling of odd input: a null or empty text is one empty section with no tokens; very long texts are encoded whole; repeated
rows each get their rows; an empty table gives an empty result; extra columns are ignored; a null array of spans has none, a
null span is empty at the start; of spans that overlap the earlier one keeps the characters; spans end where the text ends.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@functools.cache
def load_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        widths[i] = len(piece)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), widths


def attribute(ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section: token i covers bytes [ends[i-1], ends[i]); section j covers [cuts[j], cuts[j+1])."""
    starts = np.concatenate([[0], ends])[:-1]
    first = np.searchsorted(cuts, starts, "right") - 1
    last = np.searchsorted(cuts, ends - 1, "right") - 1
    if rule == "first":
        where = first
    elif rule == "last":
        where = last
    else:
        where = first.copy()
        for i in np.flatnonzero(first != last):
            edges = np.concatenate([[starts[i]], cuts[first[i] + 1 : last[i] + 1], [ends[i]]])
            where[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(where, minlength=len(cuts))


def line_cuts(data: bytes) -> np.ndarray:
    """Where the lines start; the last line may be empty."""
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1])


def _section_cuts(data: bytes, spans: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Byte cuts of the caller's spans and of what lies between them, and the section of each; spans keep their order."""
    at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
    pairs = [((s or {}).get("start") or 0, (s or {}).get("stop") or 0) for s in spans or []]
    cuts, names, end = [], [], 0
    for k in sorted(range(len(pairs)), key=lambda k: (pairs[k], k)):
        start, stop = (min(max(end, x), len(at) - 1) for x in pairs[k])
        if start > end or not cuts:
            cuts.append(end)
            names.append(-1)
        cuts.append(start)
        names.append(k)
        end = max(start, stop)
        cuts.append(end)
        names.append(-1)
    return at[np.array(cuts or [0], np.int64)], np.array(names or [-1], np.int64)


def _count(path: str, pattern: str, rule: str, lines: bool):
    def run(batches):
        encoding, widths = load_encoding(path, pattern)
        for batch in batches:
            ids, places, starts, sizes, counts = [], [], [], [], []
            for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                tokens = widths[np.array(encoding.encode_ordinary(text), np.int64)] if text else np.empty(0, np.int64)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                cuts, names = (line_cuts(data), None) if lines else _section_cuts(data, spans.as_py())
                edges = chars[np.append(cuts, len(data))]
                n, size = attribute(np.cumsum(tokens), cuts, rule), np.diff(edges)
                first = edges[:-1]
                if names is None:
                    names = np.arange(len(cuts))
                else:  # all that lies between sections is one, and none where it is nothing
                    own = names >= 0
                    order = np.flatnonzero(own)[np.argsort(names[own])]
                    rest = (int(n[~own].sum()), int(size[~own].sum()))
                    n, size, first, names = (x[order] for x in (n, size, first, names))
                    if any(rest) or not len(names):
                        n, size, first, names = np.append(n, rest[0]), np.append(size, rest[1]), np.append(first, 0), np.append(names, -1)
                ids += [i] * len(names)
                for out, x in ((places, names), (starts, first), (sizes, size), (counts, n)):
                    out.append(x)
            join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), join(places), join(starts), join(sizes), join(counts)], ["id", "section", "start", "n_chars", "n_tokens"])

    return run


def joined_fields(docs: DataFrame, fields: list[str], separator: str = "\n", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with its fields joined in ``text_col`` and the character span of each field in ``spans_col``; null fields are empty."""
    value = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0)
    for v in value:
        spans.append(F.struct(at.cast("long").alias("start"), (at + F.length(v)).cast("long").alias("stop")))
        at = at + F.length(v) + len(separator)
    return docs.select(*[c for c in docs.columns if c not in (text_col, spans_col)], F.concat_ws(separator, *value).alias(text_col), F.array(*spans).alias(spans_col))


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", spans_col: str | None = None) -> DataFrame:
    """Rows (id_col, section, start, n_chars, n_tokens), one a line or span; a document's counts add up to its tokens."""
    spans = F.lit(None) if spans_col is None else F.transform(F.col(spans_col), lambda s: F.struct(s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), spans.cast("array<struct<start: long, stop: long>>").alias("spans"))
    out = rows.mapInArrow(_count(ranks_path, pattern, rule, spans_col is None), "id long, section long, start long, n_chars long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
