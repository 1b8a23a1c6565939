"""Small cases: scoring rules, policy order, number formats, change capture, folds, streams."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answers, cdc, evidence, ledger, policy, quality, scoring, validators
from tessera.operators.windows import greedy_fill, stack_periods
from tessera.sources import snapshot
from tessera.sources.jsonl import read_jsonl, read_manifests, split_records
from tessera.streaming.windows import ingest_once, windowed_counts


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "value"), [("1,5", 1.5), ("1.5", 1.5), ("3/2", 1.5), (" 1,50 ", 1.5), ("1.000", 1000.0), ("1,000", 1.0), ("1.000.000", 1e6), ("1,000,000", 1e6), ("-2", -2.0), ("x", None), ("1/0", None), ("", None), (None, None)])
def test_parse_number(spark, text, value):
    assert one(spark, T.parse_number(T.norm_text(F.lit(text).cast("string")))) == value


def test_norm_text(spark):
    assert one(spark, T.norm_text(F.lit("  ÉCOLE −  a\tb.. "))) == "école - a b"


def test_crc16():
    assert T.crc16(b"123456789") == 0x29B1


def test_find_code(spark):
    assert one(spark, T.find_code(F.lit("ck ref-ab12 cd34 xx"), "REF")) == "REFAB12CD34"
    assert one(spark, T.find_code(F.lit("nothing"), "REF")) is None


def arr(xs, kind="string"):
    return F.array(*[F.lit(x).cast(kind) for x in xs]).cast(f"array<{kind}>")


def test_choice(spark):
    assert one(spark, scoring.choice_fraction(arr("AC"), arr("A"), partial=True)) == 0.5
    assert one(spark, scoring.choice_fraction(arr("AC"), arr("AB"), partial=True)) == 0.0
    assert one(spark, scoring.choice_fraction(arr("AC"), arr("CA"))) == 1.0


@pytest.mark.parametrize(("rule", "value"), [("steps", 0.5), ("per_statement", 0.75), ("all_or_nothing", 0.0)])
def test_statements(spark, rule, value):
    assert one(spark, scoring.statements_fraction(arr([True] * 4, "boolean"), arr([True, True, True, None], "boolean"), rule)) == value


def test_negative_marking(spark):
    s = one(spark, scoring.score(F.lit(False), F.lit(True), F.lit(0.0), F.lit(2.0), incorrect=-0.25))
    assert tuple(s) == ("incorrect", -0.5, 2.0)


def test_blank_before_kind(spark):
    assert one(spark, scoring.score(F.lit(True), F.lit(False), F.lit(1.0), F.lit(2.0)))["outcome"] == "unanswered"


def test_policy_order(spark):
    p = policy.Policy(blocking=("b", "a"))
    r = policy.reasons(p, F.lit("NEEDS_REVIEW"), F.lit("odd"), arr(["a", "x", "b"]), F.lit(True), F.lit("none"), F.lit("blocked"), F.lit(False))
    assert one(spark, r) == ["state:NEEDS_REVIEW", "review:blocked", "type:odd", "a", "b", "removed_upstream", "scoring:none", "bank_inactive"]


def test_policy_merge_drops_unknown_keys():
    assert policy.Policy().merged({"blocking": ["a"], "zzz": 1}).blocking == ("a",)


def test_snapshot_twice_is_unchanged(spark):
    snap = spark.createDataFrame([(1, "a"), (2, "b")], "id long, hash string")
    state = snap.withColumn("removed", F.lit(False))
    assert {r.change for r in cdc.snapshot_diff(state, snap, "id").collect()} == {"unchanged"}


def test_versions_move_back(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, hash string, version_no int")
    every, pointer = cdc.append_versions(v, spark.createDataFrame([(1, "a"), (2, "c")], "id long, hash string"), "id")
    assert every.count() == 3
    assert {tuple(r) for r in pointer.collect()} == {(1, 1), (2, 1)}


def test_greedy_skips(spark):
    u = spark.createDataFrame([("p", 1, 3, 1), ("p", 2, 3, 2), ("p", 3, 1, 3), ("p", 4, 9, 0)], "pool string, u long, s long, o long")
    assert {r.u for r in greedy_fill(u, ["pool"], "u", "s", ["o"], 4).collect()} == {1, 3}
    assert {r.u for r in greedy_fill(u.repartition(7, "o"), ["pool"], "u", "s", ["o"], 4).collect()} == {1, 3}


def test_stacking(spark):
    e = spark.sql("select * from values (1, 1, timestamp'2024-01-01'), (1, 2, timestamp'2024-01-02'), (1, 3, timestamp'2024-03-01') as t(u, e, ts)")
    got = {r.e: r.starts_at.isoformat()[:10] for r in stack_periods(e, "u", "e", "ts", 30).collect()}
    assert got == {1: "2024-01-01", 2: "2024-01-31", 3: "2024-03-01"}


@pytest.mark.parametrize(("status", "paid", "want"), [("expired", 5, "matched"), ("paid", 5, "late"), ("cancelled", 5, "late"), ("pending", 4, "underpaid"), (None, 5, "unmatched")])
def test_match_status(spark, status, paid, want):
    assert one(spark, ledger.match_status(F.lit(status).cast("string"), F.lit(paid), F.lit(5), F.lit(True))) == want


def test_jsonl(spark, tmp_path):
    assert read_jsonl(spark, str(tmp_path / "none"), "a long").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long").count() == 2
    good, bad = split_records(spark.read.text(str(tmp_path / "x.jsonl")).union(spark.createDataFrame([("{oops",)], "value string")), "a long")
    assert (good.count(), bad.count()) == (2, 1)


def test_manifests_last_file_wins(spark, tmp_path):
    (tmp_path / "a_Vol1.json").write_text('{"rows": [{"id": "x", "s": "1"}]}')
    (tmp_path / "b_Vol2.json").write_text('{"rows": [{"id": "x", "s": "2"}, {"id": "y", "s": "3"}]}')
    (tmp_path / "c_Vol3.json").write_text("not json")
    assert {tuple(r) for r in read_manifests(spark, str(tmp_path / "*.json"), "id string, s string", "id").collect()} == {("x", "2"), ("y", "3")}


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(ingest_once(stream, ["event_id"], "ts"), "user_id", "ts", "1 day", 5, delay=None).writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {tuple(r) for r in windowed_counts(src, "user_id", "ts", "1 day", 5).collect()}
    got = {tuple(r) for r in spark.table("w").collect()}
    assert got and got <= batch


def test_match_contexts_agrees_with_the_pairwise_rule(spark):
    import random
    import re
    import unicodedata

    from tessera.operators.contexts import match_contexts

    rnd = random.Random(3)
    norm = lambda s: re.sub(r"\s+", "", unicodedata.normalize("NFC", s or "")).lower()
    label = re.compile(r"^(?:câu|question|bài)?\d{1,3}[.:)]")
    ends = [None, "", " ", "abc", "x Abcdefg", "Abcdefgh", "zz yy abcdefgh", "tail of the Text abcdefgh", "Cau\u0302 hỏi nào đó", "Câu hỏi\u00a0nào đó"]
    starts = [None, "", "abc", "Abcdefgh", "abcdefgi", "abc defgh and so on and on", "Câu 12: abcdefgh and so", "7) abcdefgh", "abcdefgh\x1cand so on"]
    make = lambda n: [(i % 3, i, rnd.choice(ends), rnd.choice(starts)) for i in range(n)]
    places, drawings = make(60), make(60)

    def agree(p, d):
        a, b, da = norm(p[2])[-16:], norm(p[3])[:16], norm(d[2])[-16:]
        for db in (norm(d[3])[:16], label.sub("", norm(d[3]), count=1)[:16]):
            m, n = min(len(a), len(da)), min(len(b), len(db))
            if a[len(a) - m :] == da[len(da) - m :] and b[:n] == db[:n] and max(m, n) >= 8:
                return True
        return False

    want = {(p[0], p[1], d[1]) for p in places for d in drawings if p[0] == d[0] and agree(p, d)}
    frame = lambda rows, name: spark.createDataFrame(rows, f"doc_id long, {name} long, before string, after string")
    got = [tuple(r) for r in match_contexts(frame(places, "place"), frame(drawings, "drawing")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize(("x", "digits"), [(2.675, 2), (0.125, 2), (0.375, 2), (1.005, 2), (-2.675, 2), (-0.125, 2), (2.5, 0), (3.5, 0), (1e300, 2), (0.1 + 0.2, 16), (1234567.8949999999, 2), (5e-7, 6)])
def test_round_even_is_the_exact_one(spark, x, digits):
    assert one(spark, T.round_even(F.lit(x), digits)) == round(x, digits)


def test_round_even_on_many(spark):
    import random

    rnd = random.Random(1)
    xs = [rnd.choice([1, -1]) * rnd.randrange(10**7) / 10 ** rnd.randint(0, 6) for _ in range(3000)] + [k / 8 for k in range(100)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[T.round_even(F.col("x"), n).alias(f"r{n}") for n in range(5)]).collect()
    assert all(r[f"r{n}"] == round(r["x"], n) for r in got for n in range(5))


def test_transfer_text(spark):
    assert one(spark, T.ascii_content(F.lit("Nguyễn Văn Á, đơn-hàng 12!"))) == "Nguyen Van A don hang 12"
    assert one(spark, T.tlv("62", F.lit("x" * 99))) == "6299" + "x" * 99
    assert one(spark, T.tlv("62", F.lit("x" * 100))) is None


def test_duplicates_report_once(spark):
    stem = "A stem that is long enough to be compared with others, surely"
    rows = [(1, stem, ["one", "two"]), (2, stem.upper() + "!", ["One", "TWO."]), (3, stem, ["one", "three"]), (4, "short", ["one"]), (5, "short", ["one"])]
    keys = spark.createDataFrame(rows, "id long, stem string, options array<string>").select("id", quality.duplicate_keys(F.col("stem"), F.col("options")).alias("k")).select("id", "k.*")
    got = {r.id: (r.code, r.partners) for r in quality.duplicate_index(keys, "id", "exact", "near").collect()}
    assert got == {1: ("exact_duplicate", [2]), 2: ("exact_duplicate", [1]), 3: ("near_duplicate", [1, 2])}


def test_answers(spark):
    raw = "struct<kind: string, labels: array<string>, value: double, text: string, unit: string, values: array<string>>"
    rows = [
        ("short_response", ("text", None, None, " 1,50 ", None, None), [], [], ("numeric", None)),
        ("short_response", ("text", None, None, "1,50 m", None, None), [], [], ("text", None)),
        ("single_choice", ("text", None, None, "c.", None, None), ["A", "C"], ["x", "y"], ("choice", None)),
        ("single_choice", ("text", None, None, "Y ", None, None), ["A", "C"], ["x", "y."], ("choice", None)),
        ("single_choice", ("labels", ["D"], None, None, None, None), ["A", "C"], ["x", "y"], (None, "answer_not_in_options")),
        ("single_choice", ("labels", ["D"], None, None, None, None), [], [], (None, "answer_without_options")),
        ("true_false", ("text", None, None, "Đúng", None, None), [], [], ("boolean", None)),
        ("true_false_statements", ("text", None, None, "a) Đúng; b) S", None, None), [], [], ("tf_sequence", None)),
        ("true_false_statements", ("true_false_sequence", None, None, None, None, ["true", "sai", "?"]), [], [], (None, "answer_unparseable")),
        ("short_response", None, [], [], (None, None)),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], f"q string, raw {raw}, labels array<string>, texts array<string>")
    got = answers.with_answer(df, F.col("q"), F.col("raw"), F.lit("IMPORTED"), F.col("labels"), F.col("texts")).select("answer.kind", "problem").collect()
    assert [tuple(r) for r in got] == [r[4] for r in rows]


def test_shuffle_safe(spark):
    for texts, want in ((["one", "two"], True), (["A và B", "x"], False), (["Cả A, B", "x"], False), (["all of the above", "x"], False), (["only"], False), (["Tất cả", "x"], False), (["none", "Bob and Al"], True)):
        assert one(spark, answers.shuffle_safe(F.lit("single_choice"), arr(texts))) is want


@pytest.mark.parametrize(
    ("tex", "problem"),
    [(r"\frac{a}{b}", None), ("{a", "open_brace"), ("}{", "extra_brace"), (r"\{ a", None), (r"\left( a", "left_right"), (r"\leftarrow a", None), (r"\begin{a}\begin{b}\end{b}\end{a}", None), (r"\begin{a}\begin{b}\end{a}\end{b}", "end_mismatch"), (r"\begin{a}", "open_environment"), (r"\end{a}", "end_mismatch"), ("a $ b", "dollar_inside"), (r"a \$ b", None)],
)
def test_latex_problem(spark, tex, problem):
    assert one(spark, validators.latex_problem(F.lit(tex))) == problem


def test_ocr_suspect(spark):
    cases = {"": None, "plain text": None, "a�b": "replacement_character", "NÄ‘ Æ°": "wrong_encoding", "é": "not_nfc", "#@~^" * 12: "odd_characters", "a b c d e f g h i " * 3: "scattered_letters", "tiếng Việt đủ dấu và không có lỗi nào cả, nhé": None}
    for text, want in cases.items():
        assert one(spark, validators.ocr_suspect(F.lit(text))) == want


def test_stem_fixes(spark):
    stem = "What is the greatest number that divides both of these?"
    assert one(spark, evidence.strip_stem_echo(F.lit(stem), F.lit(stem + "  \n It is 4"))) == "It is 4"
    assert one(spark, evidence.strip_stem_echo(F.lit(stem), F.lit(stem))) is None
    assert one(spark, evidence.strip_stem_echo(F.lit(stem), F.lit("It is 4"))) == "It is 4"
    assert one(spark, evidence.strip_stem_echo(F.lit("short"), F.lit("short one"))) == "short one"
    assert one(spark, evidence.norm_tex(F.lit(r"$\dfrac{1}{{x}} \cdot \left( a \right)$"))) == r"\frac1x*(a)"


def test_contradicting_option(spark):
    texts = arr(["the river carries sand down toward the sea", "strong winds shape tall dunes along coasts"])
    ask = lambda stem, solution: one(spark, evidence.contradicting_option(F.lit("A"), arr("AB"), texts, F.lit(stem), F.lit(solution)))
    assert ask("Which is right?", "We know that strong winds shape tall dunes along coasts.") == "B"
    assert ask("Which is not right?", "We know that strong winds shape tall dunes along coasts.") is None
    assert ask("Which is right?", "A. no, strong winds shape tall dunes along coasts.") is None
    assert ask("Which is right?", "the river carries sand down toward the sea, of course") is None


def test_snapshot_and_report(spark, tmp_path):
    a = tmp_path / "a.jsonl"
    a.write_text("{}\n")
    paths = [str(a), str(tmp_path / "none.jsonl")]
    one_, again = snapshot.fingerprint(spark, paths, "v1"), snapshot.fingerprint(spark, paths, "v1")
    assert one_ == again and one_.endswith("@v1") and len(one_) == 19
    a.write_text("{}\n{}\n")
    assert snapshot.fingerprint(spark, paths, "v1") != one_
    snapshot.write_report(spark.createDataFrame([("x|y", 1), (None, 2)], "k string, n int"), str(tmp_path / "r"), "Title")
    assert (tmp_path / "r.md").read_text().splitlines() == ["# Title", "", "| k | n |", "| --- | --- |", r"| x\|y | 1 |", "|  | 2 |"]
    assert '"n": 2' in (tmp_path / "r.json").read_text()
    with pytest.raises(ValueError):
        snapshot.write_report(spark.range(5), str(tmp_path / "r2"), "Too long", limit=3)


def test_pending_rows_of_the_same_snapshot(spark):
    runs = spark.createDataFrame([("f1", 3), ("f1", 5), ("f0", 9)], "fingerprint string, last_key long")
    rows = spark.range(8)
    assert [r.id for r in cdc.pending(rows, runs, "id", "f1").orderBy("id").collect()] == [6, 7]
    assert cdc.pending(rows, runs, "id", "f2").count() == 8


def test_timeouts_of_a_stream(spark, tmp_path):
    from tessera.streaming.windows import timeouts

    schema = "k string, ts timestamp, s string"
    parts = [
        [("a", "2024-01-01 00:00:00", "pending"), ("b", "2024-01-01 00:00:00", "pending"), ("c", "2024-01-01 00:05:00", "pending")],
        [("b", "2024-01-01 00:10:00", "paid"), ("c", "2024-01-01 01:00:00", "pending")],
        [("z", "2024-01-01 01:10:00", "paid")],
        [("z", "2024-01-01 01:11:00", "paid")],
    ]
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(parts):
        (source / f"{i}.csv").write_text("\n".join(",".join(r) for r in rows))
        os.utime(source / f"{i}.csv", (1_700_000_000 + 10 * i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).csv(str(source))
    q = timeouts(stream, "k", "ts", "s", "pending", 1800).writeStream.format("memory").queryName("timed_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.k, str(r.due)) for r in spark.table("timed_out").collect()] == [("a", "2024-01-01 00:30:00")]
    table = spark.read.schema(schema).csv(str(source))
    assert sorted((r.k, str(r.due)) for r in timeouts(table, "k", "ts", "s", "pending", 1800).collect()) == [("a", "2024-01-01 00:30:00"), ("c", "2024-01-01 01:30:00")]


def test_refresh_of_changed_keys(spark, tmp_path):
    from tessera.streaming.refresh import current, refresh_changed

    spark.createDataFrame([(1, 5), (2, 7), (1, 6)], "k long, v long").write.parquet(str(tmp_path / "base"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"k": 1}\n{"k": 1}\n')
    base = spark.read.parquet(str(tmp_path / "base"))
    recompute = lambda keys: base.join(keys, "k", "left_semi").groupBy("k").agg(F.sum("v").alias("total"))
    run = lambda: refresh_changed(spark.readStream.schema("k long").json(str(tmp_path / "in")), ["k"], recompute, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    run()
    (tmp_path / "in" / "1.json").write_text('{"k": 2}\n')
    run()
    assert sorted(map(tuple, current(spark, str(tmp_path / "out"), ["k"]).select("k", "total").collect())) == [(1, 11), (2, 7)]
