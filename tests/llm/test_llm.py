"""Operators against brute force, round trips and odd input, on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chatformat, decontaminate, embdedup, htmltext, langid, linededup, minhash, packing, suffixdedup, tokencounts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n_lines string"


def corpus(seed=3, n=40):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "the", "Zu"]
    base = [" ".join(rnd.choices(words, k=rnd.randint(30, 120))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        t = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 3, 12])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append((i * 7 - 20, "\n".join(" ".join(t[k : k + 9]) for k in range(0, len(t), 9)), "en", "x"))
    out += [(900, None, None, "x"), (901, "", "en", None), (902, " \n\t ", "en", "x"), (903, "one two", "de", "x"), (904, "one  TWO", "de", "x"), (905, "a" * 5000, "fr", "x"), (906, "a" * 5000, "fr", "x"), (907, "long " * 300, "en", "x")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_minhash(docs):
    rows, df = docs
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if sets[a] and 100 * n >= 75 * len(sets[a] | sets[b]) and n:
                    comp[a] = min(comp[a], comp[b])
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def test_suffix(docs):
    rows, df = docs
    seen, want = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.repeated_bytes(df).collect()}
    assert got == want


def test_lines(docs):
    rows, df = docs
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    want = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        want[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.drop_repeated_lines(df, carry=("lang",)).collect()}
    assert got == want


def test_languages(spark):
    rnd = random.Random(1)
    alphabets = {"xx": "abcde", "yy": "defgh", "zz": "ghijk"}
    rows = [(i, " ".join("".join(rnd.choices(alphabets[x], k=5)) for _ in range(60)), x) for i, x in enumerate(["xx", "yy", "zz"] * 20)]
    df = spark.createDataFrame([*rows, (100, None, "xx"), (101, "12 34", "yy"), (102, "ab", None)], "doc_id long, text string, lang string")
    profiles = langid.learn_profiles(df.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict_language(df, profiles, carry=("doc_id", "lang")).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows)
    assert (got[100].lang_pred, got[101].lang_pred) == ("und", "und")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict_language(df, {}).collect()} == {"und"}


def test_packing_plan():
    rnd = random.Random(5)
    for _ in range(20):
        counts = {}
        for _ in range(200):
            n = rnd.randint(1, 100)
            counts[n] = counts.get(n, 0) + 1
        plan = packing.plan(counts, 100)
        used = {}
        for times, items in plan:
            assert sum(n * copies for n, copies in items) <= 100
            for n, copies in items:
                used[n] = used.get(n, 0) + times * copies
        assert used == counts
        assert sum(t for t, _ in plan) <= packing.lower_bound(counts, 100) + 1


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, df = docs
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {}
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = [(k, s, len(ids[s : s + 64]), packing.zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    got, seqs = {}, {}
    for r in packing.pack(df, path, capacity=64).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: sorted(x) for i, x in got.items()} == want
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("counts", [{1: 3000}, {2: 3000, 1000: 50}, {}, {2048: 5, 1: 1}])
def test_packing_plan_of_many_small_pieces(counts):
    plan = packing.plan(counts, 2048)
    used = {}
    for times, items in plan:
        for n, copies in items:
            used[n] = used.get(n, 0) + times * copies
    assert used == counts and sum(t for t, _ in plan) == packing.lower_bound(counts, 2048)


def test_packing_plan_is_the_least_on_small_cases():
    rnd = random.Random(8)

    def least(items, capacity):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                    go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    for _ in range(60):
        items = sorted((rnd.randint(3, 30) for _ in range(9)), reverse=True)
        counts = {n: items.count(n) for n in items}
        assert sum(t for t, _ in packing.plan(counts, 50)) == least(items, 50) >= packing.lower_bound(counts, 50)


def test_dominated_fillings():
    spare = lambda *ns: sum(1 << n for n in ns)
    assert packing.dominated([(5, 1), (3, 1)], 0, spare(8))
    assert packing.dominated([(5, 1)], 2, spare(7)) and packing.dominated([(5, 1)], 2, spare(1))
    assert not packing.dominated([(5, 1)], 2, spare(8, 4)) and not packing.dominated([(5, 1), (3, 1)], 0, spare(4, 6))


def test_packing_of_empty_texts_and_control_strings(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN '' END AS text", "'x' AS sequence_id", "1 AS length")
    got = packing.pack(df, path).collect()
    assert len(got) == 5000 and len({r.sequence_id for r in got}) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 5000
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "plain A<|ENDOFTEXT|>"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string"), path).collect()
    ids = [[*e.ids, 0] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in rows) == sorted([(i, len(x), packing.zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)] * 2)


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_token_counts(docs, rule):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, df = docs
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}
    got = tokencounts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule=rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.sum("n_chars").alias("c"), F.count("*").alias("k")).collect()
    assert {r.doc_id: r.n for r in got} == total
    assert {r.doc_id: (r.c, r.k) for r in got} == {i: (len(t or ""), len((t or "").split("\n"))) for i, t, *_ in rows}


def test_attribution_rules():
    ends, cuts = np.array([3, 8, 10]), np.array([0, 4])
    assert tokencounts.attribute(ends, cuts, "first").tolist() == [2, 1]
    assert tokencounts.attribute(ends, cuts, "last").tolist() == [1, 2]
    assert tokencounts.attribute(ends, cuts, "most").tolist() == [1, 2]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    rows = [(int(i), (base[i % 20] + rng.normal(size=8) * 0.25 * (i % 3)).tolist()) for i in range(60)]
    rows += [(100, rows[0][1]), (101, [2 * x for x in rows[0][1]]), (102, None), (103, [0.0] * 8), (104, [float("nan")] + [1.0] * 7), (105, [None] + [1.0] * 7), (106, [1.0, 2.0])]
    got = {r.vec_id: r for r in embdedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = [r for r in rows if r[0] < 102]
    x = np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    ids = np.array([i for i, _ in good])
    label = ids.copy()
    for _ in ids:
        label = np.array([min([label[k], *label[link[k]]]) for k in range(len(ids))])
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {**{int(i): (int(n), int(c)) for i, n, c in zip(ids, link.sum(1), label, strict=True)}, **{i: (0, i) for i in range(102, 107)}}


def test_html():
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a> <a>About us now</a></nav><div class="ad">buy these things right now please</div><main><h1>Head &amp; more</h1><p>First <b>bold</b>\n text here<br>next</p><aside>see also that</aside><div class="comments"><p>I like it a lot</p></div><p>Last words of it.</p></main><footer>&copy; someone, all rights</footer></body>'
    assert htmltext.main_text(page, {}) == "Head & more\n\nFirst bold text here next\n\nLast words of it."
    assert [htmltext.main_text(x, {}) for x in (None, "", "<p></p>", "<", "plain words only")] == ["", "", "", "", "plain words only"] or htmltext.main_text("<", {}) == "<"


def test_decontamination(spark):
    item = "Tom has 12 apples and gives 5 of them to Anna then he buys 12 more at the market for 3 dollars each day"
    other = item.replace("12", "40").replace("5", "7").replace("Tom", "Bob").replace("Anna", "Eve").replace(" 3 ", " 9 ")
    broken = other.replace("buys 40", "buys 41")
    plain = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 3)}" for i in range(60))
    docs = [(1, f"{plain} {item} {plain}"), (2, f"{plain} {other}"), (3, broken), (4, plain), (5, None), (6, "")]
    items = spark.createDataFrame([(1, item), (2, None), (3, "two words")], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got.keys() >= {1, 2} and not got.keys() & {4, 5, 6}
    assert decontaminate._pattern(np.array([False, True, False]), np.array([7, 1, 7], np.uint64)) != decontaminate._pattern(np.array([False, True, False]), np.array([7, 1, 8], np.uint64))


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\0b\\1", "<|im_start|>user\nx<|im_end|>", "<<SYS>> <|im_sep|>", None, "", "é\n\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "user", "assistant", "assistant", "odd\nrole", None], texts, strict=True))]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")
    r = chatformat.format_chats(df).select(chatformat.read_turns(F.col("formatted")).alias("t"), chatformat.read_loss(F.col("segments")).alias("l"), "formatted").first()
    assert [(x["role"], x["text"]) for x in r["t"]] == [(r or "", t or "") for _, _, r, t in rows]
    assert r["l"] == "<<SYS>> <|im_sep|>"
    assert r["formatted"].count("<|im_start|>") == 5 and "[INST]" not in r["formatted"]


def test_empty_tables(spark, empty):
    import public_tokenizers as P

    assert minhash.near_duplicates(empty).count() == 0
    assert suffixdedup.repeated_bytes(empty).count() == 0
    assert linededup.drop_repeated_lines(empty).count() == 0
    assert packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0
    assert tokencounts.count_tokens(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert langid.predict_language(empty, langid.learn_profiles(empty)).count() == 0
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert decontaminate.find_leaks(empty, items).count() == 0
    assert embdedup.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chatformat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.extract_text(pages, htmltext.learn_weights(pages)).count() == 0


def test_word_encoder_agrees_with_the_tokenizer(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "CACHE", 500)  # so that words are forgotten and met again
    encode = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    plain = [chr(c) for c in range(0x2100) if packing._PLAIN.fullmatch(chr(c))]
    cases = [f"{a}{c}{b}" for c in plain for a, b in (("", ""), ("a", "b"), ("1", "2"), ("!", "'s"), (c, f" {c}"), ("'", ""), ("A", "́"))]
    rnd = random.Random(2)
    cases += ["".join(rnd.choices(plain + list(" 'stremvld<|endoftext|>\n") * 6 + ["\x1c", "İ", "中"], k=rnd.randint(1, 25))) for _ in range(3000)]
    cases += ["<|endoftext|> x <|startoftext|>", "don't won'T I'LL we'Re 'S", "", " \n\t", "Ab\x1ccd"]
    for at in range(0, len(cases), 300):
        assert encode(cases[at : at + 300]) == encode._encode(cases[at : at + 300])


def test_components_of_chains_and_zigzags(spark):
    from tessera.llm.common import components

    rnd = random.Random(7)
    edges = [(1, 5), (5, 3), (3, 6), (6, 2)]
    for k in range(1, 60):
        ids = rnd.sample(range(100 * k, 100 * k + 100), rnd.randint(2, 9))
        edges += [rnd.choice([(a, b), (b, a)]) for a, b in zip(ids, ids[1:], strict=False)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    for part in (edges[:4], edges):
        got = components(spark.createDataFrame(part, "a long, b long")).collect()
        nodes = {x for e in part for x in e}
        assert len(got) == len(nodes)
        assert {r.id: r.component_id for r in got} == {x: find(x) for x in nodes}


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination_of_items_full_of_numbers_and_names(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    train = "A train travels 60 km in 2 hours and 90 km in 3 hours. Speed?"
    names = "Tom Anna Bob Eve Jim Sue Ann Max Leo Kim Joe Lee Amy Ben Zoe went home"
    sums = "12 + 30 = 42 and 5 + 6 = 11 so 12 x 6 = 72 or 5 x 42 = 210 or 30 x 11"
    plain = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 3)}" for i in range(40))
    items = spark.createDataFrame(list(enumerate([train, names, sums, "Why so", "1 2 3 4 5"])), "item_id long, text string")
    docs = [f"{plain} {x} {plain}" for x in (train, train.replace("60", "45").replace("90", "80"), names, sums, sums.replace("30", "31"), "Why so", train.replace("60", "2"))]
    docs += ["why so?", "why not", "6 7 8 9 10", "1 2 3 4 5", "60 km in 2 hours and 90 km in 3 hours", plain]
    got = {r.doc_id: r.item_ids for r in decontaminate.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items).collect()}
    assert got == {0: [0], 1: [0], 2: [1], 3: [2], 4: [2], 6: [0], 7: [3], 10: [4]}  # 6 has two numbers alike that differ in the item


def test_suffix_of_repeated_rows(spark):
    rnd = random.Random(11)
    a, b, c = ("".join(rnd.choices("abcdefghij ", k=400)) for _ in range(3))
    rows = [(1, a), (1, a), (2, b + a[:150]), (3, c), (3, c), (3, None), (4, "z" + b), (4, b), (5, None), (5, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixdedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {1: (400, 0), 2: (550, 150), 3: (400, 0), 4: (400, 400), 5: (0, 0)}
