"""Best-fit packing of token sequences: bin completion with branch and bound on the histogram of lengths.

Each sequence starts with the largest piece left and is completed by an undominated filling of what remains. The search goes
down by the least waste first, so the first way down is the best-fit incumbent; from there it backtracks, leaving every
branch whose waste cannot beat the incumbent, until the lower bound is met or its budget of steps is spent. Pieces of one
length are interchangeable, so the driver plans on the histogram of lengths, and a piece's rank among those of its length
picks its slot. Ranks are counted where the texts are encoded: a rank in the task, plus what the tasks before it have.

Handling of odd input: a null or empty text is the end id alone; rows with a null id are packed too, under a null id; a
repeated row is packed once for each; very long texts are encoded whole and cut into full pieces; ties in length go by task
and place in it; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import gc
import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

CAPACITY = 2048
#: Runs that a worker remembers the ids of, twice at most: those met since the last turn and those of the turn before.
CACHE = 150_000
#: Characters of a text from which on it is encoded in parts.
LONGEST = 1 << 20
#: Texts of these characters alone are split here as the tokenizer splits them; others go to it by words.
_PLAIN = re.compile("[\t-\r -~\xa0-\u012f\u0131-\u017f\u2013\u2014\u2018-\u201e\u2022\u2026\u20ac]*")
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTERS}{_DIGITS}]+")
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\r\n]")


#: How a tokenizer's file must normalise and split for its splitting to be done here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class WordEncoder:
    """Ids of whole texts by a tokenizer that never joins across white space, remembering the words it has met.

    A tokenizer of any other kind than ``NORMALIZER`` and ``SPLIT`` describe encodes the texts whole, without a memory.

    Texts that hold a string of the tokenizer's added tokens go to it whole.

    Texts of plain characters are lower-cased and cut into the runs that the tokenizer itself cuts, so that case and punctuation
    make no new runs; new runs are encoded together and told apart by their last ids, which end a word. Other texts go by words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_words = (told["normalizer"], told["pre_tokenizer"]) == (NORMALIZER, SPLIT) and told["model"].get("end_of_word_suffix") == "</w>" and not told["truncation"] and not told["padding"]
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs = Tokenizer(self.tokenizer.model)
        self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # words that have not come again since are forgotten next

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(runs), 1000):
            some = runs[at : at + 1000]
            ids = np.array(self.runs.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cut = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def _learn(self, words: set[str], encode) -> None:
        missing = words.difference(self.known)
        back = {w: self.old[w] for w in missing if w in self.old}
        self.known.update(back)
        new = list(missing.difference(back))
        self.known.update(zip(new, encode(new), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_words:
            return self._encode(texts)
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {}
        runs: list[list[str] | None] = []
        words: set[str] = set()
        new: set[str] = set()
        for t in texts:
            low = t.lower()
            if len(t) > LONGEST or any(a in low for a in self.added):
                runs.append(None)
            elif _PLAIN.fullmatch(t):
                runs.append(_PIECE.findall(low))
                new.update(runs[-1])
            elif _ODD.search(t):
                runs.append(None)
            else:
                runs.append(t.split())
                words.update(runs[-1])
        self._learn(new, self._encode_runs)
        self._learn(words, self._encode)
        get = self.known.__getitem__
        return [self._whole(t) if r is None else b"".join(map(get, r)) for t, r in zip(texts, runs, strict=True)]

    def _whole(self, text: str) -> bytes:
        """Ids of a text that has an odd blank or an added token, or is so long that it goes in parts, cut at white space."""
        low = text.lower()
        if len(text) <= LONGEST or _ODD.search(text) or any(a in low for a in self.added):
            return self._encode([text])[0]
        parts, at = [], 0
        while at < len(text):
            stop = at + LONGEST
            if stop < len(text):
                gap = _SPACE.search(text, stop)
                stop = gap.start() if gap else len(text)
            piece = text[at:stop]
            if len(piece) > 2 * LONGEST:
                parts += self._encode([piece])
            elif _PLAIN.fullmatch(piece):
                some = _PIECE.findall(piece.lower())
                self._learn(set(some), self._encode_runs)
                parts.append(b"".join(map(self.known.__getitem__, some)))
            else:
                some = piece.split()
                self._learn(set(some), self._encode)
                parts.append(b"".join(map(self.known.__getitem__, some)))
            at = stop
        return b"".join(parts)


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """One encoder a Python worker: its words serve all tasks that the worker runs."""
    return WordEncoder(path)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        encode, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        gc.disable()  # nothing here makes cycles, and each pass would walk all remembered words
        try:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for at in range(0, len(texts), 500):
                    rows = []
                    for i, data in zip(ids[at : at + 500], encode(texts[at : at + 500]), strict=True):
                        data += end
                        for k, s in enumerate(range(0, len(data), 4 * capacity)):
                            piece = data[s : s + 4 * capacity]
                            n = len(piece) // 4
                            rows.append((i, k, s // 4, n, zlib.crc32(piece), part, seen[n]))
                            seen[n] += 1
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "piece", "start", "length", "crc", "part", "r"])
        finally:
            gc.enable()

    return run


def lower_bound(counts: dict[int, int], capacity: int, most_k: int = 12) -> int:
    """Bins that any packing needs, by dual feasible functions: lengths rounded so that no full bin exceeds one.

    For a threshold e, lengths under e count nothing and lengths over capacity - e a whole bin; then, for each k, a length
    counts floor((k + 1) length / capacity) / k, or itself where that division has no remainder.
    """
    if not counts:
        return 0
    n = np.array(sorted(counts), np.int64)
    c = np.array([counts[x] for x in n.tolist()], np.int64)
    best = 0
    for e in [0, *n[2 * n <= capacity].tolist()]:
        x = np.where(n > capacity - e, capacity, np.where(n < e, 0, n))
        best = max(best, -(-int((x * c).sum()) // capacity))
        for k in range(1, most_k + 1):
            y = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
            best = max(best, -(-int((y * c).sum()) // (k * capacity)))
    return best


def _spread(bits: int, width: int) -> int:
    """The bit set moved by each of 0 to ``width`` - 1."""
    done = 1
    while done < width:
        step = min(done, width - done)
        bits |= bits << step
        done += step
    return bits if width else 0


def dominated(items: list[tuple[int, int]], slack: int, spare: int) -> bool:
    """Whether a length of the bit set ``spare`` fits in the slack, or could replace an item or several without loss.

    A spare length that is longer than an item by the slack at most, or as long as several items together or longer by the
    slack at most, fits in their place, and they fit wherever it would go: the filling that has it is as good or better.
    """
    one = more = 0
    for n, copies in items:
        for _ in range(copies):
            more |= (one << n) | (more << n)
            one |= 1 << n
    return bool(spare & ((1 << (slack + 1)) - 1 | _spread(one << 1, slack) | _spread(more, slack + 1)))


def fillings(lengths: list[int], counts: dict[int, int], gap: int, most: int, nodes: int, width: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """At most ``width`` undominated fillings of ``gap`` with a waste of ``most`` at most: (waste, [(length, copies)]), least waste first.

    ``lengths`` are descending. Most copies of the longest lengths come first, so the first filling is the best-fit one. A
    branch ends where a length closes the gap exactly, which dominates every other end, or where all that is left of the
    lengths cannot bring the waste under the bound; the bound follows the fillings found. After ``nodes`` nodes the best
    fillings so far are taken.
    """
    tail = [0] * (len(lengths) + 1)
    for k in range(len(lengths) - 1, -1, -1):
        tail[k] = tail[k + 1] + lengths[k] * counts[lengths[k]]
    rising = lengths[::-1]
    fits = lambda room: len(rising) - bisect.bisect_right(rising, room)  # noqa: E731  the first length that is no longer
    available = sum(1 << n for n in lengths)
    found: list[tuple[int, list[tuple[int, int]]]] = []

    def keep(waste: int, items: tuple) -> None:
        full = sum(1 << n for n, copies in items if copies == counts[n])
        row = (waste, sorted(items, reverse=True))
        if row not in found and not dominated(row[1], waste, available & ~full):
            found.append(row)
            found.sort(key=lambda f: (f[0], len(f[1])))
            del found[width:]

    # (next length, copies of it to try or None for all that fit, room, items)
    stack: list[tuple[int, int | None, int, tuple]] = [(0, None, gap, ())]
    while stack and nodes > 0:
        at, copies, room, items = stack.pop()
        bound = min(most, found[-1][0] - 1) if len(found) == width else most
        if copies is None:
            nodes -= 1
            k = max(at, fits(room))
            exact = counts.get(room, 0) if room and k < len(lengths) and room <= lengths[k] else 0
            if exact:
                keep(0, (*items, (room, 1)))
                continue
            if k == len(lengths):
                if room <= bound:
                    keep(room, items)
                continue
            if room - tail[k] > bound:
                continue
            at, copies = k, min(counts[lengths[k]], room // lengths[k])
        n = lengths[at]
        if copies:
            stack.append((at, copies - 1, room, items))
        left = room - copies * n
        if left - tail[at + 1] <= bound:
            stack.append((at + 1, None, left, (*items, (n, copies)) if copies else items))
        elif copies:
            stack.pop()  # fewer copies leave still more
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 400, width: int = 3, budget: int = 1000) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, copies)])]: fillings and how many sequences use each.

    A step takes the largest length left with one of its fillings, as often as the counts allow (or once, as a last
    choice), so the steps depend on the number of distinct lengths and not on the number of documents. The first way down
    is always finished; after it the search backtracks over at most ``budget`` steps.
    """
    bound, total = lower_bound(counts, capacity), sum(n * c for n, c in counts.items())
    rest, lengths = dict(counts), sorted(counts, reverse=True)
    path: list[tuple[int, list[tuple[int, int]]]] = []
    best: tuple[int, list[tuple[int, list[tuple[int, int]]]]] | None = None
    frames: list[list] = []
    bins = waste = 0

    def use(times: int, items: list[tuple[int, int]]) -> None:
        for n, copies in items:
            had = rest.get(n, 0)
            now = had - times * copies
            if not had:
                bisect.insort(lengths, n, key=lambda x: -x)
            if now:
                rest[n] = now
            else:
                del rest[n]
                lengths.remove(n)

    def options() -> list[tuple[int, list[tuple[int, int]]]]:
        top = lengths[0]
        spare = capacity * len(counts) if best is None else (best[0] - 1) * capacity - total - waste
        rest[top] -= 1
        fill = fillings([n for n in lengths if n <= capacity - top and rest[n]], rest, capacity - top, spare, nodes, width)
        rest[top] += 1
        many, once = [], []
        for _, items in fill:
            need = dict(items)
            need[top] = need.get(top, 0) + 1
            whole = list(need.items())
            times = min(rest[n] // c for n, c in whole)
            many.append((times, whole))
            if times > 1:
                once.append((1, whole))
        return many + once

    while True:
        if not lengths:
            if best is None or bins < best[0]:
                best = (bins, path[:])
        elif best is None or budget > 0:
            budget -= best is not None
            if best is None or bins + -(-(total - (bins * capacity - waste)) // capacity) < best[0]:
                frames.append([options(), False])
        if best is not None and (best[0] <= bound or budget <= 0):
            return best[1]
        while frames:  # the next choice of the last step that has one
            choices, taken = frames[-1]
            if taken:
                times, items = path.pop()
                use(-times, items)
                bins -= times
                waste -= times * (capacity - sum(n * c for n, c in items))
            if not choices:
                frames.pop()
                continue
            times, items = choices.pop(0)
            frames[-1][1] = True
            use(times, items)
            path.append((times, items))
            bins += times
            waste += times * (capacity - sum(n * c for n, c in items))
            break
        else:
            return best[1] if best else []


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Rows (id_col, piece, start, length, ids_crc32, sequence_id, offset): every piece's place in its sequence.

    The driver sees the histogram of lengths alone, at most ``capacity`` rows. No piece is shuffled unless the counts by
    task and length are too large to be sent to it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), "id long, piece int, start long, length long, crc long, part int, r long"))
    groups = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("n")).collect()}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for times, items in plan(counts, capacity):
        at = 0
        for n, copies in items:
            for _ in range(copies):
                slots.setdefault(n, []).append((used.get(n, 0), base, at))
                used[n] = used.get(n, 0) + times
                at += n
        base += times
    tables = {n: tuple(np.array(c, np.int64) for c in zip(*s, strict=True)) for n, s in slots.items()}
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(rank)), np.int64)
        for n in np.unique(length):
            first, seq, at = shared.value[int(n)]
            here = np.flatnonzero(length == n)
            k = np.searchsorted(first, rank[here], "right") - 1
            out[:, here] = seq[k] + rank[here] - first[k], at[k]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = pieces.join(before, ["length", "part"]).withColumn("p", place("length", F.col("r") + F.col("before")))
    return ranked.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "p.sequence_id", "p.offset")
