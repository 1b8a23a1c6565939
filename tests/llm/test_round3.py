"""Importance resampling, lexical search and secret scans against plain restatements, on odd input too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, embdedup, htmltext, langid, lexsearch, minhash, packing, resample, secretscan

from . import brute
from .brute import LOW
from .test_cases import crowded, families

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def resampled(docs, target, percent=10, longest=1, least=20):
    """Rows (id, features, weight, score, rank) of [(id, text)]."""

    def runs(text):
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in runs(x)[1]), Counter(b for x in target for b in runs(x)[1])
    big_s, big_t = float(sum(s.values()) + 10000), float(sum(t.values()) + 10000)
    out, pool = [], []
    for i, x in docs:
        n, bs = runs(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in bs)
        row = [i, len(bs), weight, None, None]
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            row[3] = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                pool.append(row)
        out.append(row)
    pool.sort(key=lambda r: (-r[3], r[0], r[1], r[2]))
    for rank, row in enumerate(pool[: percent * len(pool) // 100], 1):
        row[4] = rank
    return sorted(map(repr, out))


def drawn(df):
    return sorted(repr([r.doc_id, r.n_features, r.weight, r.score, r.rank]) for r in df.collect())


def odd_docs(seed, n=300):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éA", "ÉA", "x-y", "7", "日本", "Z", "K", "a\x00b", "ſ"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(n)]
    docs += [(i, docs[5][1]) for i in range(n, n + 30)]  # copies
    return docs + [(7, docs[7][1]), (7, "other text"), (None, docs[9][1]), (n + 40, None), (n + 41, ""), (n + 42, " .,- "), (n + 43, " ".join(rnd.choices(words, k=50_000)))]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_resampling_equals_brute_force(spark, longest, percent):
    docs, target = odd_docs(longest), ["w1 w2 w3 w4", None, "", "ÉA w7 w7", "x-y x-y"]
    df = crowded(spark.createDataFrame(docs, DOCS).repartition(5))
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, longest=longest)
    assert drawn(got) == resampled(docs, target, percent, longest)


def test_resampling_ranks_ties_by_id(spark):
    docs = [(i % 50, "same words " * 15) for i in range(400)]
    got = resample.resample(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame([("same",)], "text string"), percent=60)
    assert drawn(got) == resampled(docs, ["same"], 60)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 241))


def test_resampling_of_empty_tables(spark):
    none, docs = spark.createDataFrame([], DOCS), [(1, "a b c " * 10), (2, None)]
    assert resample.resample(none, spark.createDataFrame([("a",)], "text string")).count() == 0
    got = resample.resample(spark.createDataFrame(docs, DOCS), none.select("text"), percent=100)
    assert drawn(got) == resampled(docs, [], 100)


def searched(docs, items, k=20):
    """Rows (item, rank, id, score)."""
    find = lambda x: re.findall(lexsearch.TERM, (x or "").translate(LOW))
    held = [(i, find(x)) for i, x in docs if find(x)]
    big_n, big_l = len(held), sum(len(w) for _, w in held)
    counted = [(i, len(w), Counter(w)) for i, w in held]
    df = Counter(t for _, _, c in counted for t in c)
    best = {}
    for i, x in items:
        if i is not None:
            best[i] = min(x or "", best[i]) if i in best and x is not None else best.get(i, x or "")
    out = []
    for item, x in best.items():
        rows = []
        for i, n, c in counted:
            m = 75 + (25 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in find(x) if t in c)
            if s > 0 and i is not None:
                rows.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard_docs", "shard_terms", "at_once"), [(4096, 1 << 19, 4096), (16, 1 << 19, 4), (4096, 100, 3), (1, 1, 50)])
def test_search_equals_brute_force(spark, shard_docs, shard_terms, at_once):
    rnd = random.Random(shard_docs + shard_terms)
    docs = odd_docs(11)
    items = [(i, " ".join(rnd.choices(docs[rnd.randrange(300)][1].split() or ["w1"], k=rnd.randint(1, 12)))) for i in range(12)] + [(20, None), (21, "nowhere"), (22, ""), (None, "w1"), (3, "w1 w2"), (23, "w1 W1 w1 éA ÉA")]
    df = crowded(spark.createDataFrame(docs, DOCS).repartition(3))
    size = lexsearch.corpus_size(df)
    index = lexsearch.build_index(df, size, shard_docs=shard_docs, shard_terms=shard_terms)
    got = lexsearch.search(index, crowded(spark.createDataFrame(items, ITEMS)), size, at_once=at_once)
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == searched(docs, items)


def test_search_returns_all_ties_in_order_and_nothing_from_empty_tables(spark):
    docs = [(i, "alpha beta") for i in range(90, 0, -1)] + [(None, "alpha alpha")] * 40 + [(200, "beta gamma gamma")]
    df, items = spark.createDataFrame(docs, DOCS).repartition(2), [(1, "alpha"), (2, "gamma beta")]
    size = lexsearch.corpus_size(df)
    got = lexsearch.search(lexsearch.build_index(df, size, shard_docs=32), spark.createDataFrame(items, ITEMS), size)
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == searched(docs, items)
    none = spark.createDataFrame([], DOCS)
    assert lexsearch.corpus_size(none) == (0, 0)
    assert lexsearch.search(lexsearch.build_index(none, (0, 0)), spark.createDataFrame(items, ITEMS), (0, 0)).count() == 0
    assert lexsearch.search(lexsearch.build_index(df, size), spark.createDataFrame([], ITEMS), size).count() == 0


def test_search_opens_only_part_of_the_tree():
    """The bounds prune: of 4,096 documents, a search for rare and frequent terms opens far fewer nodes than there are."""
    rnd = np.random.default_rng(5)
    n, terms = 4096, 40
    postings = [np.sort(rnd.choice(n, rnd.integers(20, 2000), replace=False)) for _ in range(terms)]
    impacts = [np.sort(rnd.zipf(2.0, len(p)).clip(1, 1000))[::-1] for p in postings]
    postings = [rnd.permutation(p) for p in postings]
    seq, imp = np.concatenate(postings), np.concatenate(impacts)
    ends = np.cumsum([len(p) for p in postings])
    tree = lexsearch.Tree(n, lexsearch.Tree.sequence_bits(seq, 12), imp)
    opened, bounds = [0], tree._bounds
    tree._bounds = lambda level, *a: (opened.__setitem__(0, opened[0] + len(level)), bounds(level, *a))[1]
    weights = rnd.integers(1, 9, terms)
    docs, scores = tree.search(ends - [len(p) for p in postings], ends, weights, 20, 1)
    total = np.zeros(n, np.int64)
    for p, i, w in zip(postings, impacts, weights, strict=True):
        np.add.at(total, p, i * w)
    best = np.lexsort((np.arange(n), -total))[:20]
    order = np.lexsort((docs, -scores))[:20]
    assert list(docs[order]) == list(best) and list(scores[order]) == list(total[best])
    assert opened[0] < 2 * n / 2


def base_spans(text):
    text = text or ""
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


BITS = ["user = admin", 'username: "bob@x"', "AKIA" + "Q7" * 9, "AKIAAKIA" + "Z" * 14, "https://db.example.com:5432/x?y=1", 'token = "' + "ab12" * 8 + '"', "password: hunter22", "PassWord=abc", 'secret="xxxxx"', "api_key : Zz9+/=-", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "\n\n", "émile ", "ſecret=abcdefgh", "toKen=abcdefgh", "\n", "password=token:abcdef", "0123456789abcdef" * 2, " lorem ipsum ", "x" * 400, "日本語 "]


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices(BITS, k=rnd.randint(0, 50)))) for i in range(120)] + [(None, "token=abcdefg"), (5, "token=abcdefg"), (5, "token=abcdefg"), (130, None), (131, ""), (132, "no secrets"), (133, "token=abc"), (134, " ".join(rnd.choices(BITS, k=20_000)))]
    got = secretscan.scan_secrets(crowded(spark.createDataFrame(rows, DOCS).repartition(4)))
    key = lambda i, spans: repr((i, [sum(k == j for _, k, _ in spans) for j in range(3)], spans))
    have = got.collect()
    assert sorted(key(r.doc_id, [tuple(x) for x in r.base]) for r in have) == sorted(key(i, base_spans(t)) for i, t in rows)
    assert all([r.n_assign, r.n_access, r.n_hex] == [sum(x["kind"] == j for x in r.base) for j in range(3)] for r in have)
    assert all([x for x in r.spans if x["kind"] <= 2] == r.base for r in have)
    assert secretscan.scan_secrets(spark.createDataFrame([], DOCS)).count() == 0


def test_weak_parts_are_reported_only_together(spark):
    key, url = "wJalrXUtnFEMI/K7MDENG/bPxRfiCY1", "https://db.example.com/v1"
    texts = {
        0: f"user=admin {key} {url}",
        1: f"user=admin {key}",  # no endpoint
        2: f"user=admin {url}",  # no secret
        3: f"{key} {url}",  # no identifier
        4: f"user=admin {key}\n \n{url}",  # another block
        5: f"user=admin {key}{' x' * 160} {url}",  # out of the scope
        6: f"{url} AKIA{'Q' * 16} password=hunter22",  # strong parts count, and only the weak one is added
        7: f"{key} {url} user=admin {'y ' * 400}{key} {url}",  # the second pair has no identifier near
    }
    rows = secretscan.scan_secrets(spark.createDataFrame(list(texts.items()), DOCS)).select("doc_id", secretscan.listed(F.col("spans")).alias("s")).collect()
    got = {r.doc_id: [tuple(x.split(":")[:1]) + (texts[r.doc_id][int(x.split(":")[1]) : int(x.split(":")[2])],) for x in r.s.split(",") if x] for r in rows}
    trio = [("login", "user=admin"), ("key", key), ("endpoint", url)]
    assert got[0] == trio and sorted(got[7]) == sorted(trio)
    assert not any(got[i] for i in range(1, 6))
    assert got[6] == [("endpoint", url), ("access", "AKIA" + "Q" * 16), ("assign", "password=hunter22")]


def test_long_words_that_sums_confuse_stay_apart(spark):
    """Sums modulo 2^64 of a word of the Thue-Morse sequence and of its swap are equal, whatever the weights of the letters."""
    swap = str.maketrans("ab", "ba")
    w = "a"
    while len(w) < 4096:
        w += w.translate(swap)
    docs = [(1, w), (2, w.translate(swap)), (3, w)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    item = "one two three " + w + " four five six"
    leaks = decontaminate.find_leaks(spark.createDataFrame([(1, item), (2, item.replace(w, w.translate(swap)))], DOCS), spark.createDataFrame([(7, item)], ITEMS))
    assert [r.doc_id for r in leaks.collect()] == [1]


def test_questions_with_other_parameters_are_found(spark):
    item = "A car goes 60 km in 2 hours and stops by the old mill where Maria waits"
    asked = {
        0: item.replace("60", "75").replace("2", "3"), 1: item.replace("60", "2"), 2: item.replace("km", "metres"), 3: item.replace("km", "kilometers").replace("60", "five"), 4: item.replace("60", "sixty").replace("2", "two"),
        5: item.replace("60", "one hundred twenty"), 6: item.replace("Maria", "Anna Lena"), 7: item.replace("Maria", "Anna Lena Berg").replace("60 km", "7.5 miles"),
    }
    other = {20: item.replace("stops", "halts"), 21: item.replace("old mill", "new bridge"), 22: "A car goes fast"}
    twice = "12 red apples today and then 12 green pears are put there"
    other |= {23: twice.replace("12", "5", 1)}
    asked |= {8: twice.replace("12", "5"), 9: twice.replace("12", "twelve", 1)}  # twelve is 12
    docs = spark.createDataFrame([(i, f"so {t} now then") for i, t in (asked | other).items()], DOCS)
    got = {r.doc_id for r in decontaminate.find_leaks(docs, spark.createDataFrame([(1, item), (2, twice)], ITEMS)).collect()}
    assert got == set(asked)


def test_recall_of_new_parameters(spark):
    """Items of numbers, units and names are asked anew at random; nearly all must be found, and nothing in other texts."""
    rnd = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    numbers, units, names = ["4", "17", "250", "3.5", "seven", "forty two", "ninety"], ["km", "metres", "hours", "kilograms", "euros", "minutes"], ["Ann", "Bob Stone", "Eva", "Mary Ann Lee"]

    def fill(parts):
        return " ".join(rnd.choice(numbers) if p == "#" else rnd.choice(units) if p == "%" else rnd.choice(names) if p == "@" else p for p in parts)

    shapes = []
    for _ in range(60):
        parts = rnd.choices(words, k=24)
        for at in rnd.sample(range(1, 22, 5), 3):
            parts[at : at + 2] = rnd.choice([["#", "%"], ["#", parts[at + 1]], ["@", parts[at + 1]]])
        shapes.append(parts)
    items = spark.createDataFrame([(i, fill(s)) for i, s in enumerate(shapes)], ITEMS)
    docs = [(i, f"{' '.join(rnd.choices(words, k=30))} {fill(s)} {' '.join(rnd.choices(words, k=30))}") for i, s in enumerate(shapes)] + [(1000 + i, " ".join(rnd.choices(words, k=90))) for i in range(60)]
    got = {r.doc_id: r.item_ids for r in decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), items).collect()}
    assert all(i < 1000 and got[i] == [i] for i in got) and len(got) >= 57


BROKEN = ["<a ", '<a x="', '<a "x', '<a "x>', "<a 'x\"y>", "<p class='", "<form>", "<script>", "<!-- ", "<a b='\"><\"", "</", "<", "<x y=z ", "<div></p>"]


@pytest.mark.parametrize("part", BROKEN)
def test_broken_tags_cost_a_pass(part):
    import time

    page = part * (1_000_000 // len(part))
    began = time.process_time()
    htmltext.main_text(page, {})
    assert time.process_time() - began < 5  # a second or less on a free machine; what was quadratic took minutes


def test_pieces_join_to_the_page_without_what_is_left_out():
    rnd = random.Random(1)
    parts = ["<p>", "</p>", "<a href='x>y'>", '<b t="', '"', "'", "<", ">", "text ", "<div class=a>", "</div>", "<img/>"]
    for _ in range(300):
        page = "".join(rnd.choices(parts, k=rnd.randint(0, 30)))
        got = list(htmltext.pieces(page))
        assert "".join(t for _, t, _ in got) == page and all(page.startswith(t, at) for at, t, _ in got)


def test_forms_around_a_page_and_labels_in_it():
    page = "<body><form id=f><div class=nav><a>Home</a></div><p>One two three.</p><p>Four five</p><footer>end</footer></form></body>"
    assert htmltext.main_text(page, {}) == "One two three.\n\nFour five"
    page = "<body><article><p>One</p><label>kept</label><form><label>no</label><p>nor this</p></form></article></body>"
    assert htmltext.main_text(page, {}) == "One\n\nkept"


def test_weights_decide_where_no_name_tells(spark):
    """Weights learned from half of the pages find the text of the others after all telling names, classes and ids are gone."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = htmltext.learn_weights(pages.where("page_id % 2 = 0"))
    named = [r.html for r in pages.where("page_id % 2 = 1").select("html").collect() if r.html]
    truth = [htmltext.main_text(p, weights) for p in named]
    bare = [re.sub(r"(?i)\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"(?i)<(/?)(article|main|section|nav|header|footer|aside|form|button|label|title|dialog)\b", r"<\1div", p)) for p in named]

    def shares(texts):
        common = sum((Counter(a.split()) & Counter(b.split())).total() for a, b in zip(texts, truth, strict=True))
        return common / sum(len(t.split()) for t in texts), common / sum(len(t.split()) for t in truth)

    precision, recall = shares([htmltext.main_text(p, weights) for p in bare])
    whole = [" ".join(x for k, x, *rest in htmltext.tokens(p, weights) if k == "w") for p in bare]
    assert precision > 0.99 and recall > 0.99
    assert shares(whole)[0] < 0.97  # all text of the page: the region matters


def test_a_tokenizer_of_another_kind_encodes_whole_texts():
    from tokenizers import Tokenizer

    texts = ["Hello World  don't\nstop", "ÉA 日本 <|endoftext|> x", "", "   ", "tabs\t\tand 1234"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        encode, own = packing.WordEncoder(path), Tokenizer.from_file(path)
        assert encode.by_words == (name == "word_bpe_49k.json")
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_no_scratch_is_left_but_what_the_result_reads(spark):
    from tessera.llm import common

    docs = spark.createDataFrame([(i, f"one two three four five six seven w{i % 3}") for i in range(9)], DOCS)
    before = len(common._scratch)
    got = minhash.near_duplicates(docs)
    assert len(common._scratch) - before == 2 and {r.component_id for r in got.collect()} == {0, 1, 2}
    before = len(common._scratch)
    vectors = spark.createDataFrame([(i, [1.0, float(i % 3), 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert embdedup.embedding_duplicates(vectors).count() == 9
    assert len(common._scratch) - before == 1
    with pytest.raises(ZeroDivisionError), common.scope(spark):
        common.materialize(docs)
        1 / 0  # noqa: B018
    assert len(common._scratch) - before == 1


def test_texts_in_parts_have_the_ids_of_the_whole(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, rnd = Tokenizer.from_file(path), random.Random(7)
    words = ["Don't", "a,b", "x" * 90, "12", "é", "日本", "\n", "ÀB's", "--", "  ", "w\t", "İx", "ﬁ"]
    texts = [" ".join(rnd.choices(words[:9] if i % 2 else words, k=rnd.randint(1, 60))) for i in range(200)]
    monkeypatch.setattr(packing, "LONGEST", 40)
    encode = packing.WordEncoder(path)
    for at in range(0, 200, 20):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts[at : at + 20])] == [own.encode(t, add_special_tokens=False).ids for t in texts[at : at + 20]]


@pytest.mark.parametrize("most", [0, 10**6])
def test_ids_and_languages_on_either_side_of_their_bounds(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", most)
    monkeypatch.setattr(langid, "BROADCAST_LANGUAGES", most)
    texts = families(5, groups=6)
    docs = spark.createDataFrame(list(texts.items()), DOCS).repartition(3)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == brute.near_groups(texts)
    gone = spark.createDataFrame([(i,) for i in list(texts)[::2]], "doc_id long")
    assert sorted(r.doc_id for r in common.without_ids(docs, gone).collect()) == sorted(list(texts)[1::2])
    told = spark.createDataFrame([(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    got = langid.predict_language(told, langid.learn_profiles(told), carry=("doc_id",)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: "en" if i % 2 else "de" for i in range(40)}
