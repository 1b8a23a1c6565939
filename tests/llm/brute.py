"""Plain restatements of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def components(ids, linked):
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = list(ids)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {i: find(i) for i in ids}


def near_groups(texts):
    """{id: smallest id of its group} of {id: text}."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    return components(sets, lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))


def removed_bytes(texts, length=100):
    """{id: (bytes, removed, runs, hash of the rest)} of {id: text}."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            h = hash(b[s : s + length])
            if h in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(h)
        runs = sum(1 for m in re.finditer(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def without_lines(texts, min_chars=20, min_docs=3):
    """{id: (rest, lines, dropped)} of {id: text}."""
    key = lambda x: x.strip(WHITE).translate(LOW)
    holders = {}
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def gram_counts(text):
    """1-, 2- and 3-grams of letters; runs of anything else, and the ends, are one border."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return Counter()
    c = Counter()
    for w in words:
        p = f" {w} "
        c.update(w)
        c.update(p[k : k + 2] for k in range(len(p) - 1))
        c.update(p[k : k + 3] for k in range(len(p) - 2))
    return c


def code(gram):
    n = 0
    for ch in gram:
        n = n << 21 | (1 if ch == " " else ord(ch))
    return n


def profile(counts, size=300):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def learn(rows, size=300):
    """{language: profile} of (text, language) rows."""
    counts = {}
    for text, lang in rows:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(gram_counts(text))
    return {x: profile(c, size) for x, c in counts.items()}


def language(text, profiles, size=300):
    own = profile(gram_counts(text), size)
    if not own or not profiles:
        return "und", 0.0
    away = {}
    for x, p in sorted(profiles.items()):
        at = {g: r for r, g in enumerate(p)}
        away[x] = sum(abs(at[g] - r) if g in at else size for r, g in enumerate(own)) / (size * len(own))
    best = min(away, key=away.get)
    return best, 1 / sum(math.exp(-20 * (a - away[best])) for a in away.values())


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


UNITS = set("mm cm dm m km inch inches foot feet yard yards mile miles mg g kg t ton tons ounce ounces pound pounds ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros mph kmh km2 m2 degree degrees".split())


def template_tokens(text, names):
    """(template token, surface, literal) of each token of an ASCII text without number words; a run of names is one."""
    words = re.findall(r"[A-Za-z]+|\d+(?:[.,]\d+)*", text or "")
    out = []
    for k, w in enumerate(words):
        number = w[0].isdigit()
        unit = k > 0 and words[k - 1][0].isdigit() and w.lower() in UNITS
        name = names and w[0].isupper() and not number and not unit
        if name and out and out[-1][0] == "<c>":
            out[-1] = ("<c>", f"{out[-1][1]} {w.lower()}", False)
        elif number or unit or name:
            out.append(("<n>" if number else "<u>" if unit else "<c>", w.lower(), False))
        else:
            out.append((w.lower(), w.lower(), True))
    return out


def template_windows(text, names, width, share=0.6):
    """(template, surfaces of the slots) of each window."""
    t = template_tokens(text, names)
    return {(tuple(x[0] for x in w), tuple(x[1] for x in w if not x[2])) for w in (t[k : k + width] for k in range(len(t) - width + 1)) if sum(x[2] for x in w) >= share * width}


def templates_meet(own, other):
    """Whether a window of a document is one of an item with other slots, of which equal ones stay equal."""
    return any(a == b and all(s[j] == s[k] for j in range(len(r)) for k in range(j) if r[j] == r[k]) for a, r in own for b, s in other)
