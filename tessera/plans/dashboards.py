"""Admin dashboard, subject reconciliation and bank profile over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dashboards as D
from tessera.plans.base import query

c = F.col
_NOW = "TIMESTAMP '2001-06-30 12:00:00'"

_TABLES = f"""users AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 77 <> 0 THEN 'student' END AS role, {_NOW} - INTERVAL 1 DAY * (c_custkey % 90) AS created_at FROM customer),
periods AS (SELECT o_custkey AS user_id, CASE WHEN o_orderstatus = 'P' THEN 'revoked' ELSE 'active' END AS status, o_orderdate AS starts_at, o_orderdate + INTERVAL 90 DAY AS expires_at FROM orders WHERE o_orderkey % 3 = 0),
sessions AS (SELECT o_orderkey AS session_id, o_custkey AS user_id, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'exam' ELSE 'practice' END AS mode, CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'O' THEN 'in_progress' ELSE 'abandoned' END AS status, o_orderdate AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN 'PRO' WHEN o_orderkey % 4 < 3 THEN 'FREE' END AS plan FROM orders),
items AS (SELECT l_orderkey AS session_id, CASE WHEN l_partkey % 9 <> 0 THEN p_type END AS subject, CASE WHEN l_returnflag <> 'A' THEN l_shipdate END AS answered_at FROM lineitem JOIN part ON l_partkey = p_partkey), used AS (SELECT l_orderkey AS session_id FROM lineitem WHERE l_discount > 0.08),
pay AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'expired' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'pro' WHEN 1 THEN 'exam' ELSE 'product' END AS kind, CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice) END AS paid_amount, round(o_totalprice) + 1 AS amount, o_orderdate AS paid_at FROM orders),
tx AS (SELECT CASE event_type WHEN 'error' THEN 'unmatched' WHEN 'view' THEN 'late' WHEN 'click' THEN NULL ELSE 'matched' END AS status FROM events)"""
_PEOPLE = f"SELECT u.*, coalesce(role = 'student', false) AS student, (SELECT bool_or(starts_at <= {_NOW} AND expires_at > {_NOW}) FROM periods p WHERE p.user_id = u.user_id AND p.status = 'active') AS pro FROM users u"
_MARKED = f"SELECT s.*, session_id IN (SELECT session_id FROM used) AS paid, created_at >= {_NOW} - INTERVAL 30 DAY AS recent FROM sessions s"
_USERS = {"total": "count(*)", "students": "count_if(student)", "admins": "count_if(role = 'admin')", "pro_active": "count_if(student AND coalesce(pro, false))", "free": "count_if(student) - count_if(student AND coalesce(pro, false))", "pro_expired": "count_if(student AND NOT pro)", **{f"new_{d}d": f"count_if(created_at >= {_NOW} - INTERVAL {d} DAY)" for d in (1, 7, 30)}}
_SESSIONS = {
    "active_7d": f"count(DISTINCT CASE WHEN created_at >= {_NOW} - INTERVAL 7 DAY THEN user_id END)", "active_30d": "count(DISTINCT CASE WHEN recent THEN user_id END)", "practice": "count_if(mode = 'practice')", "practice_30d": "count_if(mode = 'practice' AND recent)", "exams": "count_if(mode = 'exam')", "exams_30d": "count_if(mode = 'exam' AND recent)",
    **{s: f"count_if(mode = 'exam' AND status = '{s}')" for s in ("submitted", "in_progress", "abandoned")}, "paid_attempts": "count_if(mode = 'exam' AND paid)", "free_attempts": "count_if(mode = 'exam' AND NOT paid)", "completion_rate": "round(count_if(mode = 'exam' AND status = 'submitted') / count_if(mode = 'exam')::DOUBLE, 3)",
}
_WORTH = "coalesce(paid_amount, amount)"
_MONEY = {"revenue": f"coalesce(sum({_WORTH}) FILTER (status = 'paid'), 0)", "revenue_30d": f"coalesce(sum({_WORTH}) FILTER (status = 'paid' AND paid_at >= {_NOW} - INTERVAL 30 DAY), 0)", "revenue_pro": f"coalesce(sum({_WORTH}) FILTER (status = 'paid' AND kind = 'pro'), 0)", "revenue_exam": f"coalesce(sum({_WORTH}) FILTER (status = 'paid' AND kind IN ('exam', 'product')), 0)"}


def _rows(section: str, figures: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{k}' AS name, ({v})::DOUBLE AS n FROM ({source})" for k, v in figures.items())


def _by(section: str, key: str, source: str, n: str = "count(*)") -> str:
    return f"SELECT '{section}' AS section, coalesce({key}, '?') AS name, {n}::DOUBLE AS n FROM ({source}) GROUP BY 2"


_DASHBOARD = " UNION ALL ".join([
    _rows("users", _USERS, _PEOPLE), _rows("sessions", _SESSIONS, _MARKED), _by("sessions_by_plan", "plan", "SELECT * FROM sessions WHERE mode = 'practice'"), _by("answered_by_subject", "subject", "SELECT * FROM items JOIN sessions USING (session_id) WHERE mode = 'practice' AND answered_at IS NOT NULL"), _rows("payments", _MONEY, "SELECT * FROM pay"),
    _by("orders_by_status", "status", "SELECT * FROM pay"), _rows("transactions", {"unmatched": "count_if(status IN ('unmatched', 'underpaid', 'late'))"}, "SELECT * FROM tx"), _by("activity", "strftime(created_at, '%Y-%m-%d') || ' ' || mode", f"SELECT * FROM ({_MARKED}) WHERE recent"),
])


@query(f"WITH {_TABLES} {_DASHBOARD}")
def r8_full_dashboard(t):
    now = F.lit("2001-06-30 12:00:00").cast("timestamp")
    o, k, days = c("o_orderkey"), c("c_custkey"), lambda n: F.make_interval(days=n)
    users = t.customer.select(k.alias("user_id"), F.when(k % 50 == 0, "admin").when(k % 77 != 0, "student").alias("role"), (now - days((k % 90).cast("int"))).alias("created_at"))
    at = c("o_orderdate").cast("timestamp")
    periods = t.orders.where(o % 3 == 0).select(c("o_custkey").alias("user_id"), F.when(c("o_orderstatus") == "P", "revoked").otherwise("active").alias("status"), at.alias("starts_at"), (at + days(F.lit(90))).alias("expires_at"))
    status = lambda f, x, e: F.when(c("o_orderstatus") == "F", f).when(c("o_orderstatus") == "O", x).otherwise(e)
    sessions = t.orders.select(o.alias("session_id"), c("o_custkey").alias("user_id"), F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "exam").otherwise("practice").alias("mode"), status("submitted", "in_progress", "abandoned").alias("status"), at.alias("created_at"), F.when(o % 4 == 0, "PRO").when(o % 4 < 3, "FREE").alias("plan"))
    items = t.lineitem.join(t.part.select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey")).select(c("l_orderkey").alias("session_id"), F.when(c("l_partkey") % 9 != 0, c("p_type")).alias("subject"), F.when(c("l_returnflag") != "A", c("l_shipdate")).alias("answered_at"))
    used = t.lineitem.where("l_discount > 0.08").select(c("l_orderkey").alias("session_id"))
    pay = t.orders.select(status("paid", "pending", "expired").alias("status"), F.when(o % 3 == 0, "pro").when(o % 3 == 1, "exam").otherwise("product").alias("kind"), F.when(o % 4 != 0, F.round("o_totalprice")).alias("paid_amount"), (F.round("o_totalprice") + 1).alias("amount"), at.alias("paid_at"))
    tx = t.events.select(F.when(c("event_type") == "error", "unmatched").when(c("event_type") == "view", "late").when(c("event_type") != "click", "matched").alias("status"))
    return D.admin_dashboard(users, periods, sessions, items, used, pay, tx, now)


_ASKED = "SELECT lang AS upstream0, CASE WHEN n_chars % 7 <> 0 THEN lang END AS upstream, CASE WHEN n_chars % 23 = 0 THEN NULL WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END AS subject, quality = 1 AS ready, quality = 1 AND toxic = 0 AS eligible, quality = 1 AND toxic = 0 AND n_chars % 3 <> 0 AS served, n_chars % 4 <> 0 AS auto, n_chars % 2 = 0 AS free, toxic = 1 AS in_review, n_chars % 5 = 0 AS by_admin FROM documents LEFT JOIN labels USING (doc_id)"
_UP = "coalesce(upstream, 'general')"
_EFF = "coalesce(subject, '_none')"


@query(f"""WITH q AS ({_ASKED}), names AS (SELECT DISTINCT {_UP} AS s FROM q UNION SELECT DISTINCT {_EFF} FROM q),
r AS (SELECT s AS subject, (SELECT count(*) FROM q WHERE {_UP} = s) AS upstream_total, (SELECT count(*) FROM q WHERE {_UP} = s AND ready) AS upstream_ready, (SELECT count(*) FROM q WHERE {_UP} = s AND in_review) AS review_required, (SELECT count(*) FROM q WHERE {_UP} = s AND {_EFF} <> s) AS mismatch_out,
  (SELECT count(*) FROM q WHERE {_EFF} = s) AS effective, (SELECT count(*) FROM q WHERE {_EFF} = s AND eligible) AS eligible, (SELECT count(*) FROM q WHERE {_EFF} = s AND served) AS served, (SELECT count(*) FROM q WHERE {_EFF} = s AND by_admin) AS admin_overrides, (SELECT count(*) FROM q WHERE {_EFF} = s AND {_UP} <> s) AS mismatch_in,
  (SELECT count(*) FROM q WHERE {_EFF} = s AND served AND auto) AS student_api, CASE WHEN s <> '_none' THEN least((SELECT count(*) FROM q WHERE {_EFF} = s AND served AND auto AND free), 15) ELSE 0 END AS free_accessible, (SELECT count(*) FROM q WHERE {_EFF} = s) - (SELECT count(*) FROM q WHERE {_EFF} = s AND served) AS excluded FROM names)
SELECT * FROM r UNION ALL SELECT 'total', {", ".join(f"sum({k})::BIGINT" for k in D.FUNNEL)} FROM r""")
def r9_reconciliation(t):
    n, ok = c("n_chars"), (c("quality") == 1) & (c("toxic") == 0)
    q = t.documents.join(t.labels, "doc_id", "left").select(F.when(n % 7 != 0, c("lang")).alias("upstream"), F.when(n % 23 == 0, None).when(n % 5 == 0, "en").otherwise(c("lang")).alias("subject"), (c("quality") == 1).alias("ready"), ok.alias("eligible"), (ok & (n % 3 != 0)).alias("served"), (n % 4 != 0).alias("auto"), (n % 2 == 0).alias("free"), (c("toxic") == 1).alias("in_review"), (n % 5 == 0).alias("by_admin"))
    return D.reconciliation(q, 15)


#: Documents as the app's questions, most of them known upstream; formulas and images are words and numbers of their texts.
_BANK = r"""app AS MATERIALIZED (SELECT doc_id AS id, CASE WHEN n_chars % 6 = 0 THEN 'NEEDS_REVIEW' ELSE 'READY_TO_SERVE' END AS state, CASE WHEN n_chars % 19 <> 0 THEN lang END AS subject, source AS subject_source, n_chars % 5 < 2 AS served, CASE WHEN n_chars % 2 = 0 THEN 'auto' ELSE 'self_check' END AS mode, CASE WHEN n_chars % 7 < 3 THEN ['type:x', 'render'][1:(n_chars % 7)::INT] ELSE [] END AS reasons,
  CASE WHEN n_chars % 31 <> 0 THEN text END AS content, CASE WHEN n_chars % 8 <> 0 THEN 'A' END AS answer, CASE WHEN n_chars % 9 > 1 THEN 'x' END AS solution, CASE WHEN doc_id % 4 = 0 THEN 'g' END AS group_key, n_chars % 3 = 0 AS has_passage, CASE WHEN n_chars % 10 = 0 THEN ['group_context_missing'] ELSE [] END AS flags,
  regexp_extract_all(text, '[0-9]{3,}') AS images, regexp_extract_all(text, '[A-Z][a-z]{9,}') AS formulas, regexp_extract_all(substr(text, 1, 500), '[A-Z][a-z]{9,}') AS shown FROM documents WHERE doc_id % 13 <> 0),
up AS MATERIALIZED (SELECT doc_id AS id, n_chars % 3 < 2 AS has_answer, n_chars % 4 = 0 AS has_solution FROM documents WHERE doc_id % 17 <> 0),
checks AS MATERIALIZED (SELECT sha256(f) AS sha, length(f) % 3 <> 0 AS ok FROM (SELECT DISTINCT unnest(formulas) AS f FROM app) WHERE length(f) % 5 <> 0), known AS (SELECT DISTINCT unnest(images) AS sha FROM app WHERE id % 3 <> 0),
joint AS MATERIALIZED (SELECT coalesce(a.id, u.id) AS id, a.id IS NOT NULL AS here, u.id IS NOT NULL AS known, coalesce(images, []) AS imgs, coalesce(served, false) AS served, coalesce(has_answer, false) AS ua, coalesce(has_solution, false) AS us, a.* EXCLUDE (id, images, served), coalesce(content IS NOT NULL, false) AS v,
  len(list_filter(coalesce(images, []), lambda i: NOT list_contains(k.ks, i))) > 0 AS lost FROM app a FULL JOIN up u ON a.id = u.id CROSS JOIN (SELECT list(sha) AS ks FROM known) k)"""
_PROBLEMS = {"missing_from_app": "NOT here", "extra_in_app": "here AND NOT known", "trusted_answer_not_usable": "here AND v AND ua AND answer IS NULL", "missing_asset": "here AND lost", "solution_dropped": "here AND v AND us AND solution IS NULL", "group_passage_empty_unflagged": "here AND v AND group_key IS NOT NULL AND NOT has_passage AND NOT list_contains(flags, 'group_context_missing')"}
_COUNTS = {"questions": "here", **_PROBLEMS, "missing_subject": "here AND subject IS NULL", "missing_version": "here AND content IS NULL", "served": "v AND served", "with_answer": "v AND answer IS NOT NULL", "with_solution": "v AND solution IS NOT NULL", "in_group": "v AND group_key IS NOT NULL", "with_images": "v AND len(imgs) > 0", "served_missing_assets": "served AND lost", "with_formula": "v AND len(formulas) > 0"}
_TEX = "SELECT f, bool_or(served) AS served, any_value(ok) AS ok, f IN (SELECT unnest(shown) FROM joint WHERE v AND served) AS shown FROM (SELECT unnest(formulas) AS f, served FROM joint WHERE v) LEFT JOIN checks ON sha = sha256(f) GROUP BY f"
_PROFILE = " UNION ALL ".join([
    _rows("counts", {k: f"count_if({v})" for k, v in _COUNTS.items()}, "SELECT * FROM joint"), _by("state", "state", "SELECT * FROM joint WHERE here"), _by("subject", "subject", "SELECT * FROM joint WHERE here"), _by("subject_source", "subject_source", "SELECT * FROM joint WHERE here"), _by("served_by_subject", "subject", "SELECT * FROM joint WHERE v AND served"), _by("served_by_mode", "mode", "SELECT * FROM joint WHERE v AND served"),
    _by("excluded_by_cause", "CASE WHEN state = 'READY_TO_SERVE' THEN 'app_check:' || coalesce(reasons[1], 'admin_disabled') ELSE state END", "SELECT * FROM joint WHERE v AND NOT served"), _by("reasons", "r", "SELECT unnest(reasons) AS r FROM joint WHERE v"),
    _rows("formulas", {"distinct": "count(*)", "served": "count_if(served)", "checked": "count(ok)", "failing": "count_if(NOT ok)", "failing_served": "count_if(NOT ok AND served)", "failing_shown": "count_if(NOT ok AND shown)"}, _TEX),
])


def _bank(t):
    n, d = c("n_chars"), c("doc_id")
    strings = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    words = lambda x: F.regexp_extract_all(x, F.lit("[A-Z][a-z]{9,}"), F.lit(0))
    app = t.documents.where(d % 13 != 0).select(
        d.alias("id"), F.when(n % 6 == 0, "NEEDS_REVIEW").otherwise("READY_TO_SERVE").alias("state"), F.when(n % 19 != 0, c("lang")).alias("subject"), c("source").alias("subject_source"), (n % 5 < 2).alias("served"), F.when(n % 2 == 0, "auto").otherwise("self_check").alias("mode"), F.when(n % 7 < 3, F.slice(strings("type:x", "render"), F.lit(1), (n % 7).cast("int"))).otherwise(strings()).alias("reasons"),
        F.when(n % 31 != 0, c("text")).alias("content"), F.when(n % 8 != 0, "A").alias("answer"), F.when(n % 9 > 1, "x").alias("solution"), F.when(d % 4 == 0, "g").alias("group_key"), (n % 3 == 0).alias("has_passage"), F.when(n % 10 == 0, strings("group_context_missing")).otherwise(strings()).alias("flags"),
        F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0)).alias("images"), words(c("text")).alias("formulas"), words(F.substring("text", 1, 500)).alias("shown_formulas"),
    )
    up = t.documents.where(d % 17 != 0).select(d.alias("id"), (n % 3 < 2).alias("has_answer"), (n % 4 == 0).alias("has_solution"))
    checks = app.select(F.explode("formulas").alias("f")).distinct().where(F.length("f") % 5 != 0).select(F.sha2("f", 256).alias("sha"), (F.length("f") % 3 != 0).alias("ok"))
    assets = app.where(c("id") % 3 != 0).select(F.explode("images").alias("sha"))
    return D.bank_profile(app, up, checks, assets)


@query(f"WITH {_BANK} {_PROFILE}")
def r10_bank_profile(t):
    return _bank(t)[0]


@query(f"WITH {_BANK} SELECT name, array_to_string(list_sort(list(id))[1:20], ',') AS ids FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, id FROM joint WHERE {v}" for k, v in _PROBLEMS.items()) + ") GROUP BY name")
def r10_problem_samples(t):
    return _bank(t)[1].select("name", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
