"""Ledger and report composites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import find_code
from tessera.operators import ledger as L
from tessera.plans.base import query

c = F.col


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END ASC NULLS LAST, o_orderkey) AS spend_order FROM orders WHERE o_orderstatus <> 'P'")
def r1_spend_order(t):
    e = F.when(c("o_orderkey") % 3 != 0, c("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy(e.asc_nulls_last(), "o_orderkey")
    return t.orders.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("spend_order"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderkey % 20 = 0) THEN NULL ELSE sum(o_orderkey % 7) END::BIGINT AS remaining FROM orders GROUP BY o_custkey")
def r2_remaining_attempts(t):
    return L.remaining_attempts(t.orders.select("o_custkey", F.when(c("o_orderkey") % 20 != 0, c("o_orderkey") % 7).alias("left")), "o_custkey", "left")


@query("SELECT p_partkey, coalesce(nullif(p_size % 3, 0), nullif(p_size % 5, 0), 99) AS price FROM part")
def r3_effective_price(t):
    return t.part.select("p_partkey", L.effective_price(c("p_size") % 3, c("p_size") % 5, F.lit(99)).alias("price"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'revoked' WHEN o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1998-01-01' THEN 'expired' WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'scheduled' ELSE 'active' END AS state FROM orders")
def r4_subscription_state(t):
    now = F.lit("1998-01-01").cast("timestamp")
    return t.orders.select("o_orderkey", L.subscription_state(c("o_orderdate"), c("o_orderdate") + F.expr("INTERVAL 30 DAY"), c("o_orderstatus") == "P", now).alias("state"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'ignored' WHEN o_orderkey IS NULL THEN 'unmatched' WHEN o_orderstatus = 'F' THEN 'late' WHEN value * 1000 < o_totalprice THEN 'underpaid' ELSE 'matched' END AS status FROM events LEFT JOIN orders ON o_orderkey = event_id * 3 AND event_id % 4 <> 0")
def r5_payment_matching(t):
    note = F.when(c("event_id") % 4 == 0, "no code").otherwise(F.concat(F.lit("for ref-"), F.lpad((c("event_id") * 3).cast("string"), 8, "0")))
    e = t.events.withColumn("code", find_code(note, "REF", "0-9"))
    o = t.orders.select(F.concat(F.lit("REF"), F.lpad(c("o_orderkey").cast("string"), 8, "0")).alias("code"), "o_totalprice", F.when(c("o_orderstatus") == "F", "paid").otherwise("pending").alias("st"))
    return e.join(o, "code", "left").select("event_id", L.match_status(c("st"), c("value") * 1000, c("o_totalprice"), c("event_type") != "error").alias("status"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 100 = 0 THEN 'ADMIN' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01') THEN 'PRO' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'EXPIRED' ELSE 'FREE' END AS plan FROM customer")
def r6_access_plan(t):
    last = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    plan = F.when(c("c_custkey") % 100 == 0, "ADMIN").when(c("last") >= F.lit("2001-01-01").cast("timestamp"), "PRO").when(c("last").isNotNull(), "EXPIRED").otherwise("FREE")
    return t.customer.join(last, "c_custkey", "left").select("c_custkey", plan.alias("plan"))


@query("""SELECT p_type, count(*) AS answered, count(*) FILTER (WHERE l_returnflag = 'N') AS correct, round(count(*) FILTER (WHERE l_returnflag = 'N') / nullif(count(*), 0)::DOUBLE, 3) AS accuracy
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('N', 'R') AND o_orderstatus <> 'P' GROUP BY p_type""")
def r7_accuracy_by_subject(t):
    items = t.lineitem.where(c("l_returnflag").isin("N", "R")).join(t.orders.where("o_orderstatus <> 'P'"), c("l_orderkey") == c("o_orderkey")).join(t.part, c("l_partkey") == c("p_partkey"))
    g = items.groupBy("p_type").agg(F.count("*").alias("answered"), F.count_if(c("l_returnflag") == "N").alias("correct"))
    return g.withColumn("accuracy", F.round(F.try_divide("correct", "answered"), 3))


@query("SELECT event_type AS metric, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY event_type")
def r8_admin_dashboard(t):
    return t.events.where(c("ts") >= F.lit("2024-01-16").cast("timestamp")).groupBy(c("event_type").alias("metric")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


_FUNNEL = """SELECT source, count(*) AS upstream, count(quality) AS effective, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS served, count(*) FILTER (WHERE quality IS NOT NULL AND NOT (quality = 1 AND toxic = 0)) AS excluded FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"""


def _funnel(t):
    ok = (c("quality") == 1) & (c("toxic") == 0)
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("upstream"), F.count("quality").alias("effective"), F.count_if(ok).alias("served"), F.count_if(c("quality").isNotNull() & ~ok).alias("excluded"))


@query(_FUNNEL)
def r9_reconciliation_funnel(t):
    return _funnel(t)


@query("SELECT count(*) AS docs, count(DISTINCT sha256(text)) AS texts, count(DISTINCT lang) AS langs, max(n_chars) AS longest, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM documents")
def r10_bank_audit(t):
    j = t.documents.join(t.labels.select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return j.agg(F.count("*").alias("docs"), F.countDistinct(F.sha2("text", 256)).alias("texts"), F.countDistinct("lang").alias("langs"), F.max("n_chars").alias("longest"), F.count_if(c("l").isNull()).alias("unlabelled"))


@query("SELECT c_mktsegment, count(o_orderkey) AS submitted, round(avg(o_totalprice / nullif(c_acctbal, 0)), 6) AS mean_ratio FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_mktsegment")
def r13_exam_statistics(t):
    j = t.customer.join(t.orders, (c("o_custkey") == c("c_custkey")) & (c("o_orderstatus") == "F"), "left")
    return j.groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("submitted"), F.round(F.avg(c("o_totalprice") / F.nullif(c("c_acctbal"), F.lit(0))), 6).alias("mean_ratio"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) GROUP BY c_custkey")
def r14_user_list(t):
    pro = t.orders.where("o_totalprice > 350000").select(c("o_custkey").alias("c_custkey")).distinct()
    return t.customer.join(pro, "c_custkey", "left_semi").join(t.orders, c("o_custkey") == c("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT lang, count(*) AS total, least(count(*), 100) AS free FROM documents GROUP BY lang")
def r15_catalogue(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("total")).withColumn("free", F.least(c("total"), F.lit(100)))


@query("SELECT c_custkey, o_orderkey AS latest, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS revealed FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1) ON o_custkey = c_custkey")
def r19_latest_seen(t):
    last = t.orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return t.customer.join(last, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", c("x.o_orderkey").alias("latest"), F.when(c("x.o_orderstatus") == "F", c("x.o_totalprice")).alias("revealed"))


@query("SELECT o_orderkey, count(l_orderkey) FILTER (WHERE l_returnflag <> 'A') AS answered FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def r20_session_history(t):
    page = t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return page.join(t.lineitem, c("l_orderkey") == c("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count_if(c("l_returnflag") != "A").alias("answered"))


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS sessions, count(l_orderkey) AS items, count(l_orderkey) FILTER (WHERE l_returnflag = 'N') AS correct FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def r23_user_detail(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("i"), F.count_if(c("l_returnflag") == "N").alias("k"))
    j = t.orders.join(per, c("l_orderkey") == c("o_orderkey"), "left")
    return j.groupBy("o_custkey").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("i"), F.lit(0)).alias("items"), F.coalesce(F.sum("k"), F.lit(0)).alias("correct"))


@query("SELECT count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-07-31') AS day, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-07-02') AS month, count(DISTINCT o_custkey) AS users, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS revenue FROM orders")
def r24_overview(t):
    since = lambda d: F.count_if(c("o_orderdate") >= F.lit(d).cast("timestamp"))
    return t.orders.agg(since("2001-07-31").alias("day"), since("2001-07-02").alias("month"), F.countDistinct("o_custkey").alias("users"), F.round(F.coalesce(F.sum(F.when(c("o_orderstatus") == "F", c("o_totalprice"))), F.lit(0.0)), 2).alias("revenue"))


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS timeline FROM events GROUP BY user_id")
def r25_timeline(t):
    g = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("es"))
    return g.select("user_id", F.array_join(F.transform("es", lambda e: e["event_type"]), ">").alias("timeline"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus = 'P' OR l_linestatus = 'F' AS revoked FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def r26_refund_cascade(t):
    return t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ((c("o_orderstatus") == "P") | (c("l_linestatus") == "F")).alias("revoked"))


@query("SELECT o_custkey, date_diff('day', DATE '2001-01-01', max(o_orderdate)::DATE) AS days_left, CASE WHEN max(o_orderdate) < TIMESTAMP '2001-01-01' THEN max(o_orderdate) END AS lapsed_at FROM orders GROUP BY o_custkey")
def r27_my_plan(t):
    g = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("m"))
    return g.select("o_custkey", F.datediff(F.to_date("m"), F.lit("2001-01-01").cast("date")).cast("long").alias("days_left"), F.when(c("m") < F.lit("2001-01-01").cast("timestamp"), c("m")).alias("lapsed_at"))


@query("SELECT a.o_orderkey, max(b.o_orderkey) AS reusable FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority AND b.o_orderkey < a.o_orderkey GROUP BY a.o_orderkey")
def r28_reuse_pending(t):
    w = Window.partitionBy("o_custkey", "o_orderstatus", "o_orderpriority").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("reusable")).where("reusable is not null")


#: Payloads of events: one object, a list or one object as data, a signed object; some are broken, or lack fields. Both sides read them.
_HOOKS = """CASE event_type
WHEN 'purchase' THEN concat('{"id": ', event_id, ', "transferAmount": "', value, '", "transferType": ', CASE user_id % 3 WHEN 0 THEN '"in"' WHEN 1 THEN '"out"' ELSE 'null' END, ', "content": "pay ', user_id, '"', CASE WHEN user_id % 2 = 0 THEN ', "description": "d"' ELSE '' END, ', "transactionDate": "2024-01-02"}')
WHEN 'click' THEN concat('{"data": [{"tid": "', CASE WHEN user_id % 2 = 0 THEN '' ELSE 't' END, '", "id": "e', event_id, '", "amount": -', value, ', "when": "2024-01-03"}, {"id": "f', event_id, '", "amount": "', value, '", "description": "x', user_id, '"}]}')
WHEN 'view' THEN concat('{"data": {"id": ', event_id, ', "amount": ', value, ', "transactionDateTime": "2024-01-04"}}')
WHEN 'signup' THEN concat('{"txn_id": "s', event_id, '", "amount": ', CASE WHEN user_id % 4 = 0 THEN '"none"' ELSE '7.9' END, ', "content": "c"}')
ELSE CASE WHEN user_id % 2 = 0 THEN 'no json' ELSE '{"data": []}' END END"""
_HOOK_KIND = "CASE event_type WHEN 'purchase' THEN 'transfer' WHEN 'signup' THEN 'signed' WHEN 'view' THEN CASE WHEN user_id % 5 = 0 THEN 'unknown' ELSE 'list' END ELSE 'list' END"
_WHOLE = "coalesce(trunc(try_cast({} AS DOUBLE))::BIGINT, 0)"


@query(f"""WITH h AS MATERIALIZED (SELECT event_id, kind, CASE WHEN json_valid(p) THEN p::JSON END AS p FROM (SELECT event_id, {_HOOK_KIND} AS kind, {_HOOKS} AS p FROM events)),
l AS (SELECT event_id, unnest(CASE json_type(json_extract(p, '$.data')) WHEN 'ARRAY' THEN json_extract(p, '$.data[*]') ELSE [json_extract(p, '$.data')] END) AS r FROM h WHERE kind = 'list' AND json_extract(p, '$.data') IS NOT NULL)
SELECT event_id, p->>'$.id' AS txn_id, {_WHOLE.format("p->>'$.transferAmount'")} AS amount, coalesce(p->>'$.content', '') || ' ' || coalesce(p->>'$.description', '') AS content, p->>'$.transactionDate' AS occurred, coalesce(p->>'$.transferType', 'in') = 'in' AS incoming FROM h WHERE kind = 'transfer' AND p IS NOT NULL
UNION ALL SELECT event_id, coalesce(nullif(r->>'$.tid', ''), r->>'$.id'), abs({_WHOLE.format("r->>'$.amount'")}), coalesce(r->>'$.description', ''), coalesce(r->>'$.when', r->>'$.transactionDateTime'), {_WHOLE.format("r->>'$.amount'")} > 0 FROM l
UNION ALL SELECT event_id, p->>'$.txn_id', {_WHOLE.format("p->>'$.amount'")}, coalesce(p->>'$.content', ''), p->>'$.occurred_at', true FROM h WHERE kind = 'signed' AND p IS NOT NULL""")
def r29_webhook_normalisation(t):
    return t.events.select("event_id", F.explode(L.webhook_transactions(F.expr(_HOOKS), F.expr(_HOOK_KIND))).alias("x")).select("event_id", "x.*")


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' AND value > 10 ORDER BY ts DESC, event_id LIMIT 100")
def r30_filtered_list(t):
    return t.events.where("event_type = 'error' and value > 10").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "ts")


@query(f"SELECT count(*) AS broken FROM ({_FUNNEL}) WHERE effective <> served + excluded")
def r31_reconciliation_alarm(t):
    return _funnel(t).where("effective <> served + excluded").agg(F.count("*").alias("broken"))


@query("SELECT o_custkey, o_orderkey, CASE WHEN lag(o_orderpriority) OVER w IS DISTINCT FROM o_orderpriority THEN 1 ELSE 0 END AS bumped FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def r32_config_changes(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", (~F.lag("o_orderpriority").over(w).eqNullSafe(c("o_orderpriority"))).cast("int").alias("bumped"))


_REVIEWED = "event_type IN ('click', 'view', 'purchase')"


@query(f"""SELECT 'day' AS part, strftime(ts, '%Y-%m-%d') AS name, count(DISTINCT props) AS n FROM events WHERE {_REVIEWED} AND ts >= TIMESTAMP '2024-01-01' GROUP BY 2
UNION ALL SELECT 'reviewer', c_name, count(DISTINCT props) FROM events JOIN customer ON c_custkey = user_id WHERE {_REVIEWED} AND ts >= TIMESTAMP '2024-01-23' GROUP BY 2
UNION ALL SELECT 'approved_week', '', count(DISTINCT props) FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-23'
UNION ALL SELECT 'reviewed_week', '', count(DISTINCT props) FROM events WHERE {_REVIEWED} AND ts >= TIMESTAMP '2024-01-23'""")
def r12_review_statistics(t):
    week = c("ts") >= F.lit("2024-01-23").cast("timestamp")
    done = t.events.where(_REVIEWED)
    n = F.countDistinct("props").alias("n")
    day = done.where(c("ts") >= F.lit("2024-01-01").cast("timestamp")).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("name")).agg(n).select(F.lit("day").alias("part"), "name", "n")
    who = done.where(week).join(t.customer, c("c_custkey") == c("user_id")).groupBy(c("c_name").alias("name")).agg(n).select(F.lit("reviewer").alias("part"), "name", "n")
    total = lambda part, df: df.agg(n).select(F.lit(part).alias("part"), F.lit("").alias("name"), "n")
    return day.union(who).union(total("approved_week", done.where(week & (c("event_type") == "purchase")))).union(total("reviewed_week", done.where(week)))


@query("""SELECT 'queue:' || q AS queue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN n_chars < 300 THEN 'short' END], lambda x: x IS NOT NULL)) AS q FROM documents d JOIN labels l ON d.doc_id = l.doc_id) GROUP BY q
UNION ALL SELECT 'reason:mail', count(*) FILTER (WHERE contains(text, '@')) FROM documents UNION ALL SELECT 'reported', count(*) FROM documents WHERE EXISTS (SELECT 1 FROM events WHERE event_id = doc_id AND event_type = 'error')""")
def r16_queue_counters(t):
    from tessera.operators.policy import queues

    j = t.documents.join(t.labels, "doc_id")
    held = j.select(F.explode(queues(toxic=c("toxic") == 1, poor=c("quality") == 0, short=c("n_chars") < 300)).alias("q")).groupBy("q").agg(F.count("*").alias("n")).select(F.concat(F.lit("queue:"), "q").alias("queue"), "n")
    reasons = queues(mail=c("text").contains("@"))
    mail = t.documents.agg(F.count_if(F.array_contains(reasons, "mail")).alias("n")).select(F.lit("reason:mail").alias("queue"), "n")
    open_ = t.events.where("event_type = 'error'").select(c("event_id").alias("doc_id"))
    reported = t.documents.join(open_, "doc_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("reported").alias("queue"), "n")
    return held.union(mail).union(reported)


#: Blueprints of orders: a pool a line, open to the banks that the bits of its part name, and fixed items of the large lines.
_POOLS = "SELECT l_orderkey, list_filter(['A', 'B', 'C', 'D'], lambda x, i: (l_partkey >> i) & 1 = 1) AS banks, CASE WHEN l_quantity > 40 THEN chr(65 + (l_suppkey % 6)::INT) END AS item FROM lineitem WHERE l_partkey % 32 < 30"


@query(f"SELECT l_orderkey, coalesce(bool_or(len(banks) = 0 OR list_contains(banks, 'A')), false) OR coalesce(bool_or(item = 'A'), false) AS compatible FROM ({_POOLS}) GROUP BY 1")
def r17_blueprint_compatibility(t):
    from tessera.operators.policy import serves_bank

    bit = lambda i: F.floor(c("l_partkey") / F.pow(F.lit(2.0), i)).cast("long") % 2 == 1
    # DuckDB counts a list's places from 1
    banks = F.filter(F.array(*map(F.lit, "ABCD")), lambda _, i: bit(i + 1))
    item = F.when(c("l_quantity") > 40, F.struct(F.char(65 + c("l_suppkey") % 6).alias("bank")))
    sections = t.lineitem.where("l_partkey % 32 < 30").groupBy("l_orderkey").agg(F.collect_list(F.struct(banks.alias("banks"))).alias("pools"), F.collect_list(item).alias("items"))
    text = F.to_json(F.struct(F.array(F.struct("pools", "items")).alias("sections")))
    config = F.from_json("text", "sections array<struct<pools: array<struct<banks: array<string>>>, items: array<struct<bank: string>>>>")
    flat = lambda get: F.flatten(F.transform(c("config.sections"), get))
    held = sections.select("l_orderkey", text.alias("text")).select("l_orderkey", config.alias("config"))
    return held.select("l_orderkey", serves_bank(flat(lambda s: F.transform(s["pools"], lambda p: p["banks"])), flat(lambda s: F.transform(s["items"], lambda i: i["bank"])), F.lit("A")).alias("compatible"))

