"""Language ID by rank-order n-gram profiles and the out-of-place distance.

Handling of odd input: a null text, or one without letters, is ``und`` with score 0; very long texts are read whole; ties
between languages go to the first name; repeated rows each get a row; with no labelled row every document is ``und``; an
empty table gives an empty result; columns other than those named are ignored unless named in ``carry``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

PROFILE = 300
#: Expected labelled rows a language in the training sample (all of them where there are fewer).
SAMPLE_PER_LANGUAGE = 2000
#: Distinct labels up to which their counts go to the texts.
BROADCAST_LANGUAGES = 100_000
_SHARPNESS = 20.0


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1-, 2- and 3-grams of the lower-cased letters; other characters are word borders."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(_letters()[c], c, 0)
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b = np.where(c > 0, c, 1)  # a border is a character of its own, so that a gram's code tells its length
    two = (b[:-1] << 21) | b[1:]
    three = (two[:-1] << 21) | b[2:]
    return np.unique(np.concatenate([c[c > 0], two, three[c[1:-1] > 0]]), return_counts=True)


def _top(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:n]]


def _count(batches):
    for batch in batches:
        sums: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums.setdefault(lang, []).append(grams(text.as_py()))
        for lang, parts in sums.items():
            codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[int]]:
    """{language: its 300 most frequent n-grams}, from a hash sample of about ``sample_per_language`` rows a language."""
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = materialize(docs.groupBy("lang").agg(F.count("*").alias("rows")))
    if sizes.count() <= BROADCAST_LANGUAGES:
        sizes = F.broadcast(sizes)  # the texts of a large language then stay where they are
    share = F.lit(float(sample_per_language)) / F.col("rows")
    sample = docs.join(sizes, "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, r in counts.withColumn("r", rank).where(F.col("r") <= PROFILE).select("lang", "gram", "r").collect():
        out.setdefault(lang, []).append((r, gram))
    return {lang: [g for _, g in sorted(rows)] for lang, rows in sorted(out.items())}


def _predict(profiles: dict[str, list[int]]):
    langs = sorted(profiles)
    codes = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in langs])) if langs else np.empty(0, np.int64)
    ranks = np.full((len(codes) + 1, max(1, len(langs))), PROFILE, np.int64)
    for j, x in enumerate(langs):
        ranks[np.searchsorted(codes, np.array(profiles[x], np.int64)), j] = np.arange(len(profiles[x]))

    def one(text: str | None) -> tuple[str, float]:
        own = _top(*grams(text), PROFILE)
        if not langs or not len(own):
            return "und", 0.0
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        at[codes[at] != own] = len(codes)
        away = np.abs(ranks[at] - np.arange(len(own))[:, None])
        away[ranks[at] == PROFILE] = PROFILE
        away = away.sum(0) / (PROFILE * len(own))
        best = int(np.argmin(away))
        return langs[best], float(1 / np.exp(-_SHARPNESS * (away - away[best])).sum())

    def run(batches):
        for batch in batches:
            found = [one(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, batch.num_columns)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names[1:], "p", "s"])

    return run


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (*carry, lang_pred, score): the language whose profile is nearest, and its softmax share (0 to 1)."""
    rows = docs.select(F.col(text_col).cast("string").alias("t"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(carry)])
    schema = ", ".join([*[f"x{i} {rows.schema[f'x{i}'].dataType.simpleString()}" for i in range(len(carry))], "p string, s double"])
    out = rows.mapInArrow(_predict(profiles), schema)
    return out.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(carry)], F.col("p").alias("lang_pred"), F.col("s").alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """The documents that no profile learns from: crc32 of the id's digits leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
