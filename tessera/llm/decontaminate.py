"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, slot consistency.

Tokens are runs of letters or digits. A template window is 13 tokens (a whole item, where it is shorter, from 5 on) in which
numbers, in digits or words, units after numbers and, in a second family, names are placeholders; a number of several words and
a run of capitalised words are one placeholder each. A document window matches an item window when their hashes are equal and
its slots are filled consistently: what is equal in the item is equal in the document. (What differs in the item may be equal in
the document: "60 km in 2 hours" asked anew may well be "2 km in 2 hours".) A window with too few literal words for placeholders
is compared as it is, token by token. An item without any placeholder window of a family has its whole length as one, from three
literal words on (from 13 tokens on, where names are slots).

Handling of odd input: null and empty texts and items match nothing; an item under 5 tokens matches only the documents whose
tokens are just its own; very long texts are read whole; repeated items count once by id; repeated documents each get a row; rows with a null id are left out; empty
tables give no match; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.hashing import CHUNK, U, mix, name_words, rolling

WINDOW, SHORTEST, LITERALS = 13, 5, 0.6
#: Literal words of a whole item that is used as one window: what the shortest placeholder window needs.
LEAST = 3
#: Kinds of windows: placeholders for numbers and units, for names too, no placeholders, all of a short text.
NUMBERS, NAMES, VERBATIM, SHORT = range(4)
#: Item windows up to which the match is a lookup in a broadcast array; beyond it all windows are hash-joined.
BROADCAST_WINDOWS = 4_000_000
# Units by rule, from prefixes and stems, and as words of their own; articles are no number words.
_PREFIXES = ["", "nano", "micro", "milli", "centi", "deci", "deca", "hecto", "kilo", "mega", "giga"]
_STEMS = ["meter", "metre", "metro", "mètre", "gram", "gramme", "gramm", "gramo", "liter", "litre", "litro", "watt", "joule", "newton", "volt", "byte", "second"]
_SYMBOLS = [p + x for p in ("", "n", "m", "c", "d", "k") for x in ("m", "g", "l", "s", "w", "j", "v", "b", "hz", "pa")]
_OTHER_UNITS = "inch inches foot feet yard mile ton tonne ounce pound gallon sec min minute hour day week month year percent dollar cent euro mph kmh km2 m2 degree t h hectare acre minuten stunde stunden tag tage woche wochen monat monate jahr jahre heure jour semaine mois an année minuto hora día semana mes meses año dólar"
UNITS = sorted({u + e for u in [p + x for p in _PREFIXES for x in _STEMS] + _SYMBOLS + _OTHER_UNITS.split() for e in ("", "s")})
_ONES = ["zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen", "null - zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn", "zéro - deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize", "cero - dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve"]
_TENS = ["- - twenty thirty forty fifty sixty seventy eighty ninety", "- - zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig", "- - vingt trente quarante cinquante soixante", "- - veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa"]
_GREAT = {"hundred": 100, "hundert": 100, "cent": 100, "cien": 100, "thousand": 1000, "tausend": 1000, "mille": 1000, "mil": 1000, "million": 10**6, "millions": 10**6, "dozen": 12}
NUMBER_WORDS = {w: n * k for k, rows in ((1, _ONES), (10, _TENS)) for row in rows for n, w in enumerate(row.split()) if w != "-"} | _GREAT
_KIND = np.zeros(256, np.int8)
_KIND[[c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 128]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_NUM, _UNIT, _CAP = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))


def _words(data: bytes):
    """Per token: hash of its lower-cased bytes, kind (1 letters, 2 digits), capital first."""
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        if stop < len(data):
            gap = np.flatnonzero(_KIND[np.frombuffer(data, np.uint8, stop - at, at)] == 0)
            stop = at + int(gap[-1]) + 1 if len(gap) else stop
        raw = np.frombuffer(data, np.uint8, stop - at, at)
        kind = _KIND[raw]
        if len(raw) > 2:  # a point or comma inside a number belongs to it
            inner = ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & (kind[:-2] == 2) & (kind[2:] == 2)
            kind[1:-1][inner] = 2
        edge = np.concatenate([[True], kind[1:] != kind[:-1], [True]])
        cut = np.flatnonzero(edge)
        first, last = cut[:-1], cut[1:]
        keep = kind[first] > 0
        first, last = first[keep], last[keep]
        two = raw[np.minimum(first + 1, len(raw) - 1)]
        cap = _UPPER[raw[first]] | ((raw[first] == 0xC3) & (two >= 0x80) & (two <= 0x9E))
        parts.append((name_words(raw.tobytes().lower(), first, last), kind[first], cap))
        at = stop
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, bool)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


_LEXICON: dict[str, np.ndarray] = {}


def _lexicon() -> dict[str, np.ndarray]:
    if not _LEXICON:
        words = sorted((int(_words(w.encode())[0][0]), n) for w, n in NUMBER_WORDS.items())
        _LEXICON["units"] = np.unique(np.concatenate([_words(u.encode())[0][-1:] for u in UNITS]))
        _LEXICON["words"], _LEXICON["values"] = np.array([w for w, _ in words], np.uint64), np.array([n for _, n in words], np.int64)
    return _LEXICON


def _value(parts: list[int]) -> int:
    """The number that a run of number words names, by what each of them is worth."""
    total = part = 0
    for n in parts:
        if n >= 1000:
            total, part = total + max(part, 1) * n, 0
        elif n == 100 or n == 12 and part:
            part = max(part, 1) * n
        else:
            part += n
    return total + part


def _merged(keep: np.ndarray, surface: np.ndarray) -> np.ndarray:
    """One surface for each kept token and the dropped ones behind it, by their order."""
    starts = np.flatnonzero(keep)
    place = np.arange(len(surface)) - np.repeat(starts, np.diff(np.append(starts, len(surface))))
    return np.add.reduceat(mix(surface ^ mix(place.astype(np.uint64))), starts) if len(starts) else surface


def templates(text: str | None):
    """Family by family (template hashes, literal flags, surfaces): numbers and units as slots, names as well, no slots."""
    lexicon = _lexicon()
    surface, kind, cap = _words((text or "").encode("utf-8", "surrogatepass"))
    at = np.minimum(np.searchsorted(lexicon["words"], surface), len(lexicon["words"]) - 1)
    spoken = lexicon["words"][at] == surface
    number = (kind == 2) | spoken
    unit = np.zeros(len(kind), bool)
    unit[1:] = number[:-1] & ~number[1:] & np.isin(surface[1:], lexicon["units"])
    raw = ~(number | unit)
    keep = np.ones(len(kind), bool)
    keep[1:] = ~(spoken[1:] & spoken[:-1])
    filled = surface.copy()
    for i in np.flatnonzero(spoken & keep):  # a number in words has the surface of its digits
        stop = i + 1
        while stop < len(kind) and spoken[stop]:
            stop += 1
        filled[i] = _words(str(_value(lexicon["values"][at[i:stop]].tolist())).encode())[0][0]
    plain = np.where(number, _NUM, np.where(unit, _UNIT, surface))
    name = cap & raw
    alone = keep.copy()
    alone[1:] &= ~(name[1:] & name[:-1])
    numbers = (plain[keep], raw[keep], filled[keep])
    names = (np.where(name, _CAP, plain)[alone], (raw & ~name)[alone], np.where(name[alone], _merged(alone, surface), filled[alone]))
    return [numbers, names, (surface, np.ones(len(surface), bool), surface)], raw


def _pattern(literal: np.ndarray, surface: np.ndarray) -> tuple[int, ...]:
    """For each slot of a window the first slot that is filled alike."""
    seen: dict[int, int] = {}
    return tuple(seen.setdefault(s, n) for n, s in enumerate(surface[~literal].tolist()))


def _hits(text: str | None, kinds: list[tuple[int, int, bool]], wanted: np.ndarray | None):
    """(window hash, slot pattern, kind) of each usable window of the (family, width, whole) ``kinds``, or only of those in ``wanted``."""
    families, raw = templates(text)
    if len(raw) < SHORTEST:  # nothing but an equal text is its match
        kinds = [(SHORT, len(raw), True)] if len(raw) else []
    out = []
    for family, w, whole in kinds:
        template, literal, surface = families[min(family, VERBATIM)]
        if len(template) < w or (family == SHORT) != (len(raw) < SHORTEST):
            continue
        h = rolling(template, w) + U(family * 1000) + U(w)
        total = np.concatenate([[0], np.cumsum(raw if family == VERBATIM else literal)])
        count = total[w:] - total[:-w]
        ok = count < LITERALS * w if family == VERBATIM else count >= (min(LEAST, w) if whole else LITERALS * w) if family != SHORT else np.ones(1, bool)
        if wanted is not None and len(wanted):
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            ok &= wanted[at] == h
        for i in np.flatnonzero(ok):
            out.append((int(h[i : i + 1].view(np.int64)[0]), _pattern(literal[i : i + w], surface[i : i + w]), (family, w, whole)))
    return out


def _item_hits(text: str | None):
    length = [len(f[0]) for f in templates(text)[0]]
    hits = _hits(text, [(f, min(WINDOW, length[f]), False) for f in (NUMBERS, NAMES, VERBATIM) if length[f]], None)
    for family, shortest in ((NUMBERS, SHORTEST), (NAMES, WINDOW)):
        if length[family] >= shortest and not any(kind[0] == family for _, _, kind in hits):
            hits += _hits(text, [(family, length[family], True)], None)
    return hits


def _item_windows(batches):
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows += [(i, *kind, h, p) for h, p, kind in _item_hits(text.as_py())]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["item", "family", "w", "whole", "h", "p"])


def _doc_windows(kinds: list[tuple[int, int, bool]], shared):
    def run(batches):
        wanted = None if shared is None else shared.value
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(i, h, p) for h, p in {(h, p) for h, p, _ in _hits(text.as_py(), kinds, wanted)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["id", "h", "p"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (id_col, item_ids, n_windows), one a document that holds a window of an item."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null")
    known = materialize(items.mapInArrow(_item_windows, "item long, family int, w int, whole boolean, h long, p array<int>").distinct())
    kinds = sorted(tuple(r) for r in known.select("family", "w", "whole").distinct().collect())
    keys = known.select("h").distinct()
    shared = None
    if keys.count() <= BROADCAST_WINDOWS:
        shared = spark.sparkContext.broadcast(np.sort(keys.toArrow()["h"].to_numpy().view(np.uint64)))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    if not kinds:
        return docs.where("false").select(F.col("id").alias(id_col), F.lit(None).cast("array<long>").alias("item_ids"), F.lit(0).cast("long").alias("n_windows"))
    found = docs.mapInArrow(_doc_windows(kinds, shared), "id long, h long, p array<int>")
    # a window that many items share is joined once, with the list of them
    known = known.groupBy("h", F.col("p").alias("q")).agg(F.collect_set("item").alias("items"))
    same = F.forall(F.zip_with("q", "p", lambda first, own: F.get(F.col("p"), first) == own), lambda x: x)
    hits = found.join(known, "h").where(same)
    return hits.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"), F.countDistinct("h").alias("n_windows")).withColumnRenamed("id", id_col)
