"""Odd input, ties, long texts, clashing columns and whole stages, against plain restatements."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import chatformat, decontaminate, embdedup, htmltext, langid, linededup, minhash, packing, suffixdedup, tokencounts

from . import brute

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that the operators use inside.
CLASHING = ["id", "n", "h", "p", "c", "m", "k", "x", "s", "r", "t", "l", "v", "a", "b", "d1", "d2", "h1", "h2", "core", "uni", "bucket", "turn", "hub", "rest", "drops", "part", "length", "salt", "item", "links", "low", "key", "interval", "loss", "ts", "x0", "x1", "spans", "span"]


def crowded(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING if c not in df.columns])


def families(seed, groups=12, size=9, words=90, share=0.12):
    """Groups of edited copies of one text: {id: text}."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    out = {}
    for g in range(groups):
        base = rnd.choices(vocabulary, k=words)
        common = rnd.choices(vocabulary, k=words)
        for k in range(size):
            t = base[:]
            for _ in range(int(words * share * rnd.random())):
                t[rnd.randrange(words)] = rnd.choice(vocabulary)
            if g % 3 == 0:  # much in common, but not enough of it
                t = common[: int(words * 0.62)] + rnd.choices(vocabulary, k=int(words * 0.38))
            out[g * 100 + k] = " ".join(t)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_minhash_on_families_of_copies(spark, seed):
    texts = families(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == brute.near_groups(texts)


def test_prefix_pairs_lose_no_link(spark):
    rnd = random.Random(9)
    sets = {i: set(rnd.sample(range(40), rnd.randint(3, 30))) for i in range(60)}
    for i in range(60, 120):
        sets[i] = set(sets[i - 60])
        for _ in range(rnd.randint(0, 5)):
            sets[i] ^= {rnd.randrange(60)}
    sets = {i: s for i, s in sets.items() if s}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")
    got = {tuple(sorted(r)) for r in minhash.prefix_pairs(df, None, 75).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert want <= got and len(got) < len(sets) * (len(sets) - 1) / 4


def test_suffix_of_long_texts(spark):
    rnd = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyz    "
    long = "".join(rnd.choices(alphabet, k=(1 << 21) + 5000))
    texts = {1: long, 2: long[(1 << 20) - 70 : (1 << 20) + 90] + "x" * 300, 3: "y" + long[1000:1250] + "z" + long[2_000_000:], 4: "ab" * 400, 5: None}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.repeated_bytes(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.removed_bytes(texts)


def test_suffix_of_a_passage_with_many_neighbours(spark):
    rnd = random.Random(6)
    passage = "".join(rnd.choices("abcdefgh ", k=160))
    part = lambda n: "".join(rnd.choices("ijklmnop ", k=n))
    texts = {i: part(150) + passage[rnd.randint(0, 20) : 160 - rnd.randint(0, 20)] + part(150) for i in range(80)}
    texts |= {100 + i: texts[i][3:] for i in range(20)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.repeated_bytes(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.removed_bytes(texts)


def test_stretches_dealt_by_content():
    """The rows of a rank with many stretches, folded in three tasks, dealt and compared, give what one comparison gives."""
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    n = 4000
    core, uni = rnd.integers(0, 3, n).astype(np.uint64), rnd.integers(1, 900, n).astype(np.uint64)  # hashes are never 0, which marks have
    doc, pos = np.arange(n), np.zeros(n, np.int64)
    zero = np.zeros(n, np.int64)
    old, suffixdedup.HOT = suffixdedup.HOT, 100
    try:
        rows = [b for part in np.array_split(rnd.permutation(n), 3) for b in suffixdedup._fold(core[part], uni[part], core[part], doc[part], pos[part], zero[part], zero[part])]
    finally:
        suffixdedup.HOT = old
    t = pa.Table.from_batches(rows)
    assert {suffixdedup.MARK, suffixdedup.DEALT} <= set((t.column("m").to_numpy() >> 16).tolist())
    t = t.sort_by([(c, "ascending") for c in ("core", "uni", "doc", "pos")])
    out = pa.Table.from_batches(list(suffixdedup._rank(t.to_batches(max_chunksize=37))))
    kind, got = out.column("m").to_numpy() >> 16, out.column("doc").to_numpy()
    first = {}
    for k in range(n):
        first.setdefault((core[k], uni[k]), k)
    assert sorted(got.tolist()) == list(range(n))
    assert set(got[kind != suffixdedup.REPEAT].tolist()) == set(first.values())


def test_lines_with_and_without_broadcast(spark, monkeypatch):
    rnd = random.Random(2)
    lines = [f"A common line of text, number {k}  " for k in range(12)] + ["short", "", "\tA COMMON line of text, number 3"]
    texts = {i: "\n".join(rnd.choices(lines, k=6)) for i in range(40)}
    texts[50], texts[51] = None, "x" * 2_000_000 + "\n" + lines[0]
    df = crowded(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).repartition(3)
    want = brute.without_lines(texts)
    for most in (linededup.BROADCAST_KEYS, 0):
        monkeypatch.setattr(linededup, "BROADCAST_KEYS", most)
        assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.drop_repeated_lines(df, carry=("h1", "drops")).collect()} == want


def test_languages_against_brute_force(spark):
    rnd = random.Random(7)
    parts = {"de": "sch ung ein der die".split(), "en": "th ing the of and".split(), "fr": "eau que les oui été".split()}
    rows = [(i, " ".join("".join(rnd.choices(parts[x], k=rnd.randint(1, 3))) for _ in range(rnd.randint(1, 50))), x) for i, x in enumerate(["de", "en", "fr"] * 30)]
    rows += [(200, None, "en"), (201, " 12 -", None), (202, "The" * 400_000, None), (203, "ÉTÉ eau", None), (204, rows[0][1], None), (204, rows[0][1], None)]
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string, lang string")).repartition(2)
    profiles = brute.learn([(t, x) for i, t, x in rows if not brute.held_out(i)])
    got = langid.predict_language(df, langid.learn_profiles(df.where(~langid.held_out())), carry=("doc_id", "p")).collect()
    assert len(got) == len(rows)
    want = {i: brute.language(t, profiles) for i, t, _ in rows}
    assert all(r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-9 for r in got)


def test_language_ties_go_to_the_first_name():
    same = [brute.code(g) for g in brute.profile(brute.gram_counts("the same text"))]
    out = langid._predict({"zz": same, "aa": same})
    import pyarrow as pa

    (batch,) = out([pa.RecordBatch.from_arrays([pa.array(["the same text"])], ["t"])])
    assert batch.column(0).to_pylist() == ["aa"] and batch.column(1).to_pylist() == [0.5]


@pytest.mark.parametrize("rule", ["first", "last"])
def test_tokens_of_lines_and_spans(spark, rule):
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    texts = {i: "".join(rnd.choices("ab  c\n\n.,Wxyz the of", k=rnd.randint(0, 200))) for i in range(30)}
    texts[40] = "word " * 300_000 + "\nend"
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    offsets = {i: tok.encode(t, add_special_tokens=False).offsets for i, t in texts.items()}
    place = lambda o: o[0] if rule == "first" else o[1] - 1
    df = crowded(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2))
    got = {}
    for r in tokencounts.count_tokens(df, RANKS, public_tokenizers.PATTERN, rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.n_chars, r.n_tokens)
    for i, t in texts.items():
        at, want = 0, {}
        for k, line in enumerate(t.split("\n")):
            size = len(line) + (at + len(line) < len(t))
            want[k] = (at, size, sum(at <= place(o) < at + size for o in offsets[i]))
            at += size
        assert got[i] == want
    spans = {i: [(3, 9), (9, 9), (20, 50), (45, 70), (500, 900)] for i in texts}
    rows = [(i, t, [{"start": a, "stop": b} for a, b in spans[i]]) for i, t in texts.items()] + [(99, "no spans", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<start: int, stop: int>>")
    got = {}
    for r in tokencounts.count_tokens(df, RANKS, public_tokenizers.PATTERN, rule=rule, spans_col="sections").collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.n_chars, r.n_tokens)
    assert list(got.pop(99)) == [-1]
    for i, t in texts.items():
        end, want, owner = 0, {}, {}
        for k, (a, b) in enumerate(spans[i]):
            a, b = min(max(a, end), len(t)), min(max(b, end), len(t))
            end = max(a, b)
            want[k] = [a, b - a, 0]
            owner |= dict.fromkeys(range(a, b), k)
        rest = [0, len(t) - len(owner), 0]
        for o in offsets[i]:
            want.get(owner.get(place(o), -1), rest)[2] += 1
        if rest[1] or rest[2] or not want:
            want[-1] = rest
        assert got[i] == {k: tuple(v) for k, v in want.items()}


def test_tokens_of_fields(spark):
    df = spark.createDataFrame([(1, "A title here", "body of the text"), (2, None, "x"), (3, "", None)], "doc_id long, title string, body string")
    out = tokencounts.count_tokens(tokencounts.joined_fields(df, ["title", "body"]), RANKS, public_tokenizers.PATTERN, spans_col="spans")
    got = {(r.doc_id, r.section): (r.n_chars, r.n_tokens) for r in out.collect()}
    assert got == {(1, 0): (12, 3), (1, 1): (16, 4), (1, -1): (1, 1), (2, 0): (0, 0), (2, 1): (1, 1), (2, -1): (1, 1), (3, 0): (0, 0), (3, 1): (0, 0), (3, -1): (1, 1)}


def test_best_region_is_the_greatest_sum():
    rnd = random.Random(5)
    for _ in range(300):
        x = [rnd.choice([-3, -2, -1, 0, 1, 2]) for _ in range(rnd.randint(0, 14))]
        a, b = htmltext.best_region([float(v) for v in x])
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])
    assert htmltext.best_region([1.0, -5.0, 1.0]) == (0, 1)  # the first of equals


ARTICLE = "<html><body><nav><a>Home</a></nav><article><h1>Head</h1>%s<p>And the end of it.</p></article><footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<p class='search-term'>kept one</p>", "kept one"),
        ("<div class='social-history'>kept two</div>", "kept two"),
        ("<p>so <math><mi>x</mi> equals y</math> now</p>", "so x equals y now"),
        ("<p>a &lt;b&gt; &amp; &#233;&nbsp;c</p>", "a <b> & é c"),
        ("<div class='ad'>buy</div>", None),
        ("<div class='cookie-notice'>we use</div>", None),
        ("<form><label>name</label><input></form>", None),
        ("<section id='comments'><p>first</p></section>", None),
        ("<p class=ad>gone<p>kept three", "kept three"),
        ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> -->", None),
    ],
)
@pytest.mark.parametrize("weights", [{}, {"wdiv": -2.0, "cad": -5.0, "csearch-term": 2.0}])
def test_html_inside_an_article(inner, text, weights):
    assert htmltext.main_text(ARTICLE % inner, weights) == "\n\n".join(x for x in ("Head", text, "And the end of it.") if x)


def test_html_by_learned_classes(spark):
    page = lambda k: f"<html><body><div class='qq'>note {k} of the house which is long enough</div><article><p>some text number {k} of the page itself</p></article></body></html>"
    pages = crowded(spark.createDataFrame([(k, f"u{k}", page(k)) for k in range(20)] + [(30, None, None), (31, "u", ""), (32, "u", "<p>" + "word " * 300_000), (0, "u0", page(0))], "page_id long, url string, html string"))
    weights = htmltext.learn_weights(pages)
    assert weights["cqq"] <= htmltext.OUTSIDE
    assert htmltext.main_text("<body><article><p>one two three</p><div class='qq'>a note</div><p>four</p></article></body>", weights) == "one two three\n\nfour"
    got = htmltext.extract_text(pages, weights).collect()
    assert len(got) == 24 and {r.text for r in got if r.page_id in (30, 31)} == {""}
    assert [len(r.text) for r in got if r.page_id == 32] == [5 * 300_000 - 1] and [r.text for r in got if r.page_id == 0] == ["some text number 0 of the page itself"] * 2


def test_decontamination_checks_slots(spark):
    item = "Tom has 12 apples and gives away some so 12 minus five remain"
    docs = [item.replace("12", "40"), item.replace("12", "40", 1), item.replace("Tom", "Eve"), item, "x " + item.lower().replace("apples", "pears")]
    got = decontaminate.find_leaks(crowded(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")), crowded(spark.createDataFrame([(7, item)], "item_id long, text string"))).collect()
    assert {r.doc_id: r.item_ids for r in got} == {0: [7], 2: [7], 3: [7]}  # 1 fills one slot in two ways


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(12)
    words = ["the", "of", "sum", "more", "Anna", "Bob", "km", "hours", "12", "7", "3.5", "costs", "each", "then", "adds"]
    items = {i: " ".join(rnd.choices(words, weights=[6, 6, 5, 5, 1, 1, 1, 1, 2, 2, 1, 5, 5, 5, 5], k=rnd.randint(14, 30))) for i in range(25)}
    docs = {}
    for i in range(80):
        t = items[rnd.randrange(25)].split()
        for _ in range(rnd.choice([0, 1, 2])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        swap = {"12": rnd.choice(["12", "99"]), "Anna": rnd.choice(["Anna", "Zoe"])}
        docs[i] = " ".join(["so", *(swap.get(w, w) for w in t), "it", "is"])
    docs[90], docs[91] = None, docs[0]
    got = {r.doc_id: r.item_ids for r in decontaminate.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = {}
    for d, text in docs.items():
        found = []
        for i, item in items.items():
            hit = False
            for names in (False, True):
                own = brute.template_windows(item, names, 13)
                whole = not own and sum(x[2] for x in brute.template_tokens(item, names)) >= decontaminate.LEAST
                width = len(brute.template_tokens(item, names))
                hit |= brute.templates_meet(own, brute.template_windows(text, names, 13))
                whole = whole and (not names or width >= 13)
                hit |= whole and brute.templates_meet(brute.template_windows(item, names, width, 0), brute.template_windows(text, names, width, 0))
            low = [x[1] for x in brute.template_tokens(item, False)]
            in_doc = [x[1] for x in brute.template_tokens(text, False)]
            plain = [x[2] for x in brute.template_tokens(item, False)]
            starts = {tuple(in_doc[k : k + 13]) for k in range(len(in_doc) - 12)}
            hit |= any(tuple(low[k : k + 13]) in starts for k in range(len(low) - 12) if sum(plain[k : k + 13]) < 0.6 * 13)
            if hit:
                found.append(i)
        if found:
            want[d] = found
    assert got == want


@pytest.mark.parametrize("numbers", [embdedup.NUMBERS, 800])
def test_embeddings_of_many_directions(spark, monkeypatch, numbers):
    monkeypatch.setattr(embdedup, "NUMBERS", numbers)  # 800: intervals of 50 vectors
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:200] + rng.normal(size=(200, 16)) * 0.35, base[:50] * 3.0, base[:20]])
    ids = [*range(550), *range(20)]  # rows of one id twice: each is a vector
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embdedup.embedding_duplicates(crowded(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(3)).collect())
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.array(ids)
    for _ in range(60):
        label = np.array([min([label[k], *label[link[k]]]) for k in range(len(ids))])
    assert got == sorted((i, int(n), int(c)) for i, n, c in zip(ids, link.sum(1), label, strict=True))


def test_chats_with_repeated_rows_and_clashing_columns(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "x" * 1_500_000), (2, 0, "assistant", None), (None, 0, "user", "lost")]
    got = {r.conv_id: r for r in chatformat.format_chats(crowded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).select("conv_id", F.size(chatformat.read_turns(F.col("formatted"))).alias("n"), F.length(chatformat.read_loss(F.col("segments"))).alias("loss")).collect()}
    assert {k: (r.n, r.loss) for k, r in got.items()} == {1: (3, 1_500_000), 2: (1, 0), None: (1, 0)}


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    rnd = random.Random(21)
    parts = {"de": "schaft ung ein der die keit".split(), "en": "thing ing the of and ation".split()}
    word = lambda x: "".join(rnd.choices(parts[x], k=rnd.randint(1, 3))) + rnd.choice(["", "s", "en"])
    line = "this line stands in very many documents"
    item = " ".join(word("en") for _ in range(20))
    rows = []
    for i in range(60):
        x = rnd.choice(["de", "en"])
        text = "\n".join([" ".join(word(x) for _ in range(30)), *([line] if i % 4 == 0 else []), " ".join(word(x) for _ in range(30))])
        rows.append((i, text, x, "s", len(text)))
    rows += [(100 + i, rows[i][1] + " plus", rows[i][2], "s", 9) for i in range(6)]
    rows += [(200, f"{rows[7][1]} {item} {rows[8][1]}", "en", "s", 9), (201, None, None, None, None), (202, "", "en", "s", 0), (203, "12 34", "en", "s", 5), (204, line, "en", "s", 9), (204, line, "en", "s", 9)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_pipeline_stages_against_brute_force(spark, small_corpus):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    folder, rows = small_corpus
    stages = dict(P.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    profiles = brute.learn([(r[1], r[2]) for r in rows if not brute.held_out(r[0])])
    keep = [r for r in rows if (p := brute.language(r[1], profiles))[0] != "und" and p[1] >= P.MIN_SCORE]
    docs = stages["language_id"](spark, docs, folder)
    as_rows = lambda df: sorted(map(tuple, df.select(*P.COLUMNS).collect()))
    assert as_rows(docs) == sorted(keep) and docs.columns == list(P.COLUMNS)
    lines = brute.without_lines({r[0]: r[1] for r in keep})
    keep = [(r[0], t := lines[r[0]][0], r[2], r[3], len(t)) for r in keep]
    docs = stages["line_dedup"](spark, docs, folder)
    assert as_rows(docs) == sorted(keep)
    groups = brute.near_groups({r[0]: r[1] for r in keep})
    keep = [r for r in keep if groups[r[0]] == r[0]]
    docs = stages["near_dedup"](spark, docs, folder)
    assert as_rows(docs) == sorted(keep)
    keep = [r for r in keep if r[0] != 200]
    docs = stages["decontamination"](spark, docs, folder)
    assert as_rows(docs) == sorted(keep)
    tok = Tokenizer.from_file(WORD_BPE)
    sizes = {}
    for r in keep:
        sizes[r[0]] = sizes.get(r[0], 0) + len(tok.encode(r[1], add_special_tokens=False).ids) + 1
    packed = stages["best_fit_packing"](spark, docs, folder).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == sizes and len({r.sequence_id for r in packed}) == -(-sum(sizes.values()) // packing.CAPACITY)
    whole = P.run(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole} == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed}


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
