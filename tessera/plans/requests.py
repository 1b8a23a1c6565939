"""Practice requests, detail views, evidence and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import promotion as P
from tessera.operators import requests as R
from tessera.plans import promotion as Q
from tessera.plans.base import query

c = F.col

_POOL = "SELECT doc_id AS item, lang AS subject, source AS kind, n_chars % 6 <> 0 AS auto, doc_id % 9 = 0 AS free, CASE WHEN lang = 'en' THEN doc_id // 24 WHEN (doc_id // 5) % 3 = 0 THEN doc_id // 5 + 10000 END AS group_key FROM documents"
_ASKED = "SELECT s_suppkey AS request_id, s_suppkey % 20 AS user_id, CASE s_suppkey % 5 WHEN 3 THEN 'wrong' WHEN 4 THEN 'bookmarks' ELSE 'all' END AS source, CASE s_nationkey % 6 WHEN 4 THEN ['en', 'de'] WHEN 5 THEN []::VARCHAR[] ELSE [['en', 'de', 'fr', 'xx'][s_nationkey % 6 + 1]] END AS subjects, CASE WHEN s_suppkey % 7 = 0 THEN ['src1', 'src2'] ELSE []::VARCHAR[] END AS kinds, s_suppkey % 2 = 0 AS auto_only, s_suppkey % 3 = 0 AS free_only, s_suppkey % 12 AS open, s_suppkey * 13 % 130 AS wanted FROM supplier"
_OWNED = "SELECT user_id % 20 AS user_id, CASE event_type WHEN 'error' THEN 'wrong' ELSE 'bookmarks' END AS source, event_id % 400 AS item FROM events WHERE event_type IN ('error', 'signup') AND event_id % 5 = 0"
_FOUND = f"""asked AS MATERIALIZED ({_ASKED}), pool AS MATERIALIZED ({_POOL}),
found AS MATERIALIZED (SELECT a.request_id, wanted, item, group_key, NOT free_only OR free AS usable FROM asked a JOIN pool p ON (len(a.subjects) = 0 OR list_contains(a.subjects, p.subject)) AND (NOT a.auto_only OR p.auto) AND (len(a.kinds) = 0 OR list_contains(a.kinds, p.kind))
  WHERE a.open < 10 AND (a.source = 'all' OR EXISTS (SELECT 1 FROM ({_OWNED}) o WHERE o.user_id = a.user_id AND o.source = a.source AND o.item = p.item))),
counts AS MATERIALIZED (SELECT request_id, count(*) AS every, count(*) FILTER (usable) AS available, least(count(*) FILTER (usable), any_value(wanted), 100) AS n FROM found GROUP BY 1),
mine AS MATERIALIZED (SELECT f.request_id, n, item, coalesce('g' || group_key, 'i' || item) AS unit FROM found f JOIN counts USING (request_id) WHERE usable AND n > 0),
units AS MATERIALIZED (SELECT request_id, n, unit, size, row_number() OVER (PARTITION BY request_id ORDER BY sha256('s:' || request_id || ':' || unit), unit) AS j FROM (SELECT request_id, n, unit, count(*) AS size FROM mine GROUP BY ALL) WHERE size <= 8),
fill AS (SELECT request_id, n, 0::BIGINT AS j, ''::VARCHAR AS unit, 0::BIGINT AS used, false AS took FROM counts WHERE n > 0 UNION ALL
  SELECT f.request_id, f.n, u.j, u.unit, CASE WHEN used + size <= f.n THEN used + size ELSE used END, used + size <= f.n FROM fill f JOIN units u ON u.request_id = f.request_id AND u.j = f.j + 1),
reached AS MATERIALIZED (SELECT request_id, max(used) = any_value(n) AS whole FROM fill GROUP BY 1),
drawn AS MATERIALIZED (SELECT m.request_id, row_number() OVER (PARTITION BY m.request_id ORDER BY f.j, item) AS position, item, true AS whole FROM mine m JOIN fill f ON f.request_id = m.request_id AND f.unit = m.unit AND f.took JOIN reached r ON r.request_id = m.request_id AND r.whole
  UNION ALL SELECT request_id, position, item, false FROM (SELECT m.request_id, n, item, row_number() OVER (PARTITION BY m.request_id ORDER BY sha256('s:' || m.request_id || ':' || item), item) AS position FROM mine m JOIN reached r ON r.request_id = m.request_id AND NOT r.whole) WHERE position <= n)"""


def _answered(t, draw):
    s, n = c("s_suppkey"), c("s_nationkey") % 6
    strings = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    subjects = F.when(n == 4, strings("en", "de")).when(n == 5, strings()).otherwise(F.array(F.get(strings("en", "de", "fr", "xx"), n)))
    asked = t.supplier.select(s.alias("request_id"), (s % 20).alias("user_id"), F.when(s % 5 == 3, "wrong").when(s % 5 == 4, "bookmarks").otherwise("all").alias("source"), subjects.alias("subjects"), F.when(s % 7 == 0, strings("src1", "src2")).otherwise(strings()).alias("kinds"), (s % 2 == 0).alias("auto_only"), (s % 3 == 0).alias("free_only"), (s % 12).alias("open"), (s * 13 % 130).alias("wanted"))
    five = F.floor(c("doc_id") / 5)
    pool = t.documents.select(c("doc_id").alias("item"), c("lang").alias("subject"), c("source").alias("kind"), (c("n_chars") % 6 != 0).alias("auto"), (c("doc_id") % 9 == 0).alias("free"), F.when(c("lang") == "en", F.floor(c("doc_id") / 24)).when(five % 3 == 0, five + 10000).alias("group_key"))
    owned = t.events.where(c("event_type").isin("error", "signup") & (c("event_id") % 5 == 0)).select((c("user_id") % 20).alias("user_id"), F.when(c("event_type") == "error", "wrong").otherwise("bookmarks").alias("source"), (c("event_id") % 400).alias("item"))
    return R.answer_requests(asked, pool, owned, "s", draw)


@query(f"WITH RECURSIVE {_FOUND} SELECT a.request_id, CASE WHEN open >= 10 THEN 'too_many_open' WHEN coalesce(available, 0) = 0 AND free_only AND coalesce(every, 0) > 0 THEN 'free_limit' WHEN coalesce(available, 0) = 0 THEN 'not_enough' ELSE 'drawn' END AS outcome, coalesce(available, 0) AS available, coalesce(d.taken, 0) AS taken, d.whole FROM asked a LEFT JOIN counts USING (request_id) LEFT JOIN (SELECT request_id, count(*) AS taken, bool_or(whole) AS whole FROM drawn GROUP BY 1) d USING (request_id)")
def r18_practice_requests(t):
    return _answered(t, False)[0]


@query(f"WITH RECURSIVE {_FOUND} SELECT request_id, position, item FROM drawn")
def r18_drawn_items(t):
    return _answered(t, True)[1]


_VERSIONS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_tax) AS version_no, substr(md5(l_suppkey::VARCHAR), 1, 8) AS content_hash, strftime(l_shipdate, '%Y-%m-%d') AS created_at, l_suppkey AS created_by FROM lineitem"


def _versions(t):
    from pyspark.sql import Window

    rows = t.lineitem.select(c("l_partkey").alias("p_partkey"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax")  # named first: what groups by the name needs no second shuffle
    rows = rows.withColumn("version_no", F.row_number().over(Window.partitionBy("p_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax")))
    return rows.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), "p_partkey", "version_no", F.substring(F.md5(c("l_suppkey").cast("string")), 1, 8).alias("content_hash"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("created_at"), c("l_suppkey").alias("created_by"))


@query(f"""WITH v AS (SELECT l_partkey AS p_partkey, string_agg(version_no || ':' || content_hash || ':' || created_at, ' ' ORDER BY version_no DESC, id DESC) AS versions FROM ({_VERSIONS}) GROUP BY 1),
u AS (SELECT p_partkey, string_agg(o || '=' || n, ' ' ORDER BY o) AS usage FROM (SELECT l_partkey AS p_partkey, CASE WHEN l_returnflag = 'A' THEN 'pending' ELSE l_returnflag END AS o, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT p_partkey, string_agg(event_id || event_type, ' ' ORDER BY event_id DESC) AS reports FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY event_id DESC) AS i FROM (SELECT event_id, event_type, event_id * event_id % 97 AS p_partkey FROM events)) WHERE i <= 50 GROUP BY 1),
k AS (SELECT o_custkey % 200 AS p_partkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey DESC) AS corrections FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT p_partkey, versions, usage, reports, corrections FROM part LEFT JOIN v USING (p_partkey) LEFT JOIN u USING (p_partkey) LEFT JOIN r USING (p_partkey) LEFT JOIN k USING (p_partkey)""")
def r21_question_detail(t):
    items = t.lineitem.select(c("l_partkey").alias("p_partkey"), F.when(c("l_returnflag") != "A", c("l_returnflag")).alias("outcome"))
    reports = t.events.select(c("event_id").alias("id"), c("event_type").alias("status"), (c("event_id") * c("event_id") % 97).alias("p_partkey"))
    corrections = t.orders.where("o_orderstatus = 'P'").select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("field"), (c("o_custkey") % 200).alias("p_partkey"))
    d = R.question_details(t.part.select("p_partkey"), _versions(t), items, reports, corrections, "p_partkey")
    line = lambda name, f: F.when(c(name).isNotNull(), F.array_join(F.transform(name, f), " ")).alias(name)
    usage = F.when(c("usage").isNotNull(), F.array_join(F.transform(F.map_entries("usage"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")).alias("usage")
    return d.select("p_partkey", line("versions", lambda v: F.concat_ws(":", v["version_no"], v["content_hash"], v["created_at"])), usage, line("reports", lambda r: F.concat(r["id"], r["status"])), line("corrections", lambda r: r["id"].cast("string")))


@query(f"""WITH q AS (SELECT p_partkey, arg_max(id, version_no) AS cur, arg_min(id, version_no) AS up, arg_max(id, version_no) FILTER (created_by % 3 = 0) AS draft FROM (SELECT *, l_partkey AS p_partkey FROM ({_VERSIONS})) GROUP BY 1),
v AS (SELECT p_partkey, string_agg(version_no || ':' || coalesce(s_name, '-') || CASE WHEN id = cur THEN 'c' ELSE '' END || CASE WHEN id IS NOT DISTINCT FROM draft THEN 'd' ELSE '' END || CASE WHEN id = up THEN 'u' ELSE '' END, ' ' ORDER BY version_no DESC, id DESC) AS versions FROM (SELECT *, l_partkey AS p_partkey FROM ({_VERSIONS})) JOIN q USING (p_partkey) LEFT JOIN supplier ON created_by = s_suppkey AND s_suppkey % 4 <> 0 GROUP BY 1),
h AS (SELECT p_partkey, string_agg(event_id || event_type || coalesce(s_name, '-'), ' ' ORDER BY event_id DESC) AS history FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY event_id DESC) AS i FROM (SELECT *, event_id * event_id % 31 AS p_partkey FROM events)) LEFT JOIN supplier ON user_id = s_suppkey AND s_suppkey % 4 <> 0 WHERE i <= 200 GROUP BY 1),
f AS (SELECT o_custkey % 300 AS p_partkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderstatus, o_orderpriority, o_orderkey % 7, o_orderkey) AS findings FROM orders WHERE o_totalprice > 300000 GROUP BY 1),
i AS (SELECT l_partkey AS p_partkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT p_partkey, versions, history, findings, coalesce(n, 0) AS used_in_attempts FROM q LEFT JOIN v USING (p_partkey) LEFT JOIN h USING (p_partkey) LEFT JOIN f USING (p_partkey) LEFT JOIN i USING (p_partkey)""")
def r22_review_detail(t):
    v = _versions(t)
    pick = v.groupBy("p_partkey").agg(F.max_by("id", "version_no").alias("current_version_id"), F.min_by("id", "version_no").alias("upstream_version_id"), F.max_by(F.when(c("created_by") % 3 == 0, c("id")), F.when(c("created_by") % 3 == 0, c("version_no"))).alias("draft_version_id"))
    events = t.events.select(c("event_id").alias("id"), c("event_type").alias("action"), c("user_id").alias("actor_id"), (c("event_id") * c("event_id") % 31).alias("p_partkey"))
    findings = t.orders.where("o_totalprice > 300000").select(c("o_orderkey").alias("id"), (c("o_orderkey") % 7).alias("code"), c("o_orderpriority").alias("severity"), c("o_orderstatus").alias("status"), (c("o_custkey") % 300).alias("p_partkey"))
    users = t.supplier.where("s_suppkey % 4 <> 0").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    d = R.review_details(pick, v, events, findings, t.lineitem.where("l_returnflag <> 'N'").select(c("l_partkey").alias("p_partkey")), users, "p_partkey")
    mark = lambda v, k, s: F.when(v[k], s).otherwise("")
    line = lambda name, f: F.when(c(name).isNotNull(), F.array_join(F.transform(name, f), " ")).alias(name)
    return d.select("p_partkey", line("versions", lambda v: F.concat(v["version_no"], F.lit(":"), F.coalesce(v["by"], F.lit("-")), mark(v, "is_current", "c"), mark(v, "is_draft", "d"), mark(v, "is_upstream", "u"))), line("history", lambda e: F.concat(e["id"], e["action"], F.coalesce(e["by"], F.lit("-")))), line("findings", lambda f: f["id"].cast("string")), "used_in_attempts")


_KINDS = ["answer_key_table", "answer_statement", "solution_conclusion", "solution_section"]
_LABEL = "[substr('ABCD', (length(text) // {0} % 4 + 1)::INT, 1)]"
#: Answers of documents and their occurrences at two to four others, which mostly agree.
_EVIDENCE = f"""questions AS MATERIALIZED (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'numeric' WHEN 1 THEN 'text' ELSE 'choice' END AS kind, {_LABEL.format(50)} AS labels, CASE WHEN doc_id % 27 <> 0 THEN (n_chars % 10)::DOUBLE END AS value, CASE WHEN n_chars % 8 = 0 THEN 'AUTOMATICALLY_INFERRED_CANDIDATE' ELSE 'SOURCE_PROVIDED_ANSWER' END AS provided,
  CASE n_chars % 4 WHEN 0 THEN 'chọn ' || {_LABEL.format(50)}[1] WHEN 1 THEN 'Vì thế chọn đáp án ' || {_LABEL.format(70)}[1] || '.' WHEN 2 THEN 'Chọn A, chọn B' END AS solution FROM documents),
occurrences AS MATERIALIZED (SELECT e.event_id % 1100 AS doc_id, CASE WHEN e.event_id % 13 = 0 THEN {_LABEL.format(70)} WHEN e.event_id % 11 <> 0 THEN {_LABEL.format(50)} END AS labels, CASE WHEN e.event_id % 14 = 0 THEN n_chars % 10 + 1.0 WHEN e.event_id % 5 <> 0 THEN (n_chars % 10)::DOUBLE END AS value, CASE WHEN e.event_id % 17 <> 0 THEN [{_KINDS}[e.event_id // 1100 % 2 * (e.event_id % 4) + 1]] END AS evidence FROM events e JOIN documents d ON d.doc_id = e.event_id % 1100 WHERE e.event_id < 3300)"""


@query(rf"""WITH {_EVIDENCE}, proof AS (SELECT doc_id, list_distinct(list(labels[1]) FILTER (len(labels) > 0)) AS ks, list_distinct(list(value) FILTER (value IS NOT NULL)) AS vs, coalesce(list_distinct(flatten(list(evidence) FILTER (evidence IS NOT NULL))), []) AS es, coalesce(list_distinct(flatten(list(evidence) FILTER (evidence IS NOT NULL AND value IS NOT NULL))), []) AS ns FROM occurrences GROUP BY 1)
SELECT doc_id, CASE WHEN kind = 'text' THEN 'no_answer' WHEN provided <> 'SOURCE_PROVIDED_ANSWER' THEN 'not_provided'
WHEN kind = 'numeric' THEN CASE WHEN value IS NULL THEN 'no_value' WHEN coalesce(len(vs), 0) = 0 THEN 'no_evidence' WHEN len(list_filter(vs, lambda x: abs(x - value) > 1e-9 * greatest(1, abs(x)))) > 0 THEN 'sources_disagree' WHEN len(ns) < 2 AND NOT list_has_any(ns, ['answer_statement', 'solution_conclusion']) THEN 'single_evidence' END
WHEN coalesce(len(ks), 0) = 0 THEN 'no_evidence' WHEN len(ks) > 1 OR ks[1] <> labels[1] THEN 'sources_disagree' WHEN len(es) < 2 AND NOT list_has_any(es, ['answer_statement', 'solution_conclusion', 'option_highlight', 'option_color']) THEN 'single_evidence'
WHEN len(list_distinct(regexp_extract_all(coalesce(solution, ''), '(?i)chọn (?:đáp án )?([A-D])(?:[^\p{{L}}\p{{N}}]|$)', 1))) = 1 AND upper(regexp_extract(solution, '(?i)chọn (?:đáp án )?([A-D])(?:[^\p{{L}}\p{{N}}]|$)', 1)) <> labels[1] THEN 'solution_disagrees' END AS reason FROM questions LEFT JOIN proof USING (doc_id)""")
def e4_answer_evidence(t):
    label = lambda k: F.array(F.substring(F.lit("ABCD"), (F.floor(F.length("text") / k) % 4).cast("int") + 1, F.lit(1)))
    n, d = c("n_chars"), c("doc_id")
    solution = F.when(n % 4 == 0, F.concat(F.lit("chọn "), F.get(label(50), F.lit(0)))).when(n % 4 == 1, F.concat(F.lit("Vì thế chọn đáp án "), F.get(label(70), F.lit(0)), F.lit("."))).when(n % 4 == 2, "Chọn A, chọn B")
    questions = t.documents.select("doc_id", F.when(d % 9 == 0, "numeric").when(d % 9 == 1, "text").otherwise("choice").alias("kind"), label(50).alias("labels"), F.when(d % 27 != 0, (n % 10).cast("double")).alias("value"), F.when(n % 8 == 0, "AUTOMATICALLY_INFERRED_CANDIDATE").otherwise("SOURCE_PROVIDED_ANSWER").alias("provided"), solution.alias("solution"))
    e = c("event_id")
    seen = t.events.where("event_id < 3300").select("event_id", (e % 1100).alias("doc_id")).join(t.documents, "doc_id")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.floor(e / 1100) % 2 * (e % 4)).cast("int"))
    occurrences = seen.select("doc_id", F.when(e % 13 == 0, label(70)).when(e % 11 != 0, label(50)).alias("labels"), F.when(e % 14 == 0, n % 10 + 1.0).when(e % 5 != 0, (n % 10).cast("double")).alias("value"), F.when(e % 17 != 0, F.array(kind)).alias("evidence"))
    return R.answer_evidence(questions, occurrences, "doc_id")


@query("WITH u AS (SELECT doc_id, nullif(md5(substr(text, 1, 1)), md5('A')) AS media, length(text) % 3 > 0 AS light FROM documents), n AS (SELECT media, count(*) AS n_uses FROM u GROUP BY 1) SELECT doc_id, n_uses, CASE WHEN u.media IS NULL THEN 'keep' WHEN n_uses >= 3 AND light THEN 'remove' ELSE 'image' END AS action FROM u LEFT JOIN n ON n.media = u.media")
def g8_repeated_media(t):
    media = F.nullif(F.md5(F.substring("text", 1, 1)), F.md5(F.lit("A")))
    return R.repeated_media(t.documents.select("doc_id", media.alias("media"), (F.length("text") % 3 > 0).alias("light")), "media", c("light")).select("doc_id", "n_uses", "action")


@query("""WITH q AS (SELECT doc_id, md5(text || lang) AS fp FROM documents), r AS (SELECT d.doc_id, l.toxic = 1 AS dirty, CASE WHEN d.doc_id % 5 > 0 THEN 6 + (d.n_chars % 3)::INT END AS validator_version, CASE WHEN quality = 1 THEN md5(text || lang) ELSE md5(text) END AS validated_hash FROM documents d JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN validated_hash IS DISTINCT FROM fp OR validator_version IS DISTINCT FROM 7 THEN 'validate' ELSE 'skip' END AS step FROM q LEFT JOIN r USING (doc_id) WHERE coalesce(dirty, false) OR validator_version IS DISTINCT FROM 7""")
def q9_refresh_plan(t):
    reviews = t.documents.join(t.labels, "doc_id").select("doc_id", (c("toxic") == 1).alias("dirty"), F.when(c("doc_id") % 5 > 0, 6 + (c("n_chars") % 3).cast("int")).alias("validator_version"), F.when(c("quality") == 1, F.md5(F.concat("text", "lang"))).otherwise(F.md5("text")).alias("validated_hash"))
    return R.refresh_plan(t.documents, reviews, "doc_id", 7, F.md5(F.concat("text", "lang")))



@query(f"""WITH p AS ({Q._PARTS.replace("FROM_HERE", Q._QUESTIONS)}), s AS (SELECT doc_id, unnest([{{'scan': 'broken', 'reason': CASE WHEN gate IS NULL THEN {Q._STRUCTURE} END}}, {{'scan': 'incomplete', 'reason': CASE WHEN gate IS NULL THEN {Q._INCOMPLETE} END}}, {{'scan': 'exhibit', 'reason': CASE WHEN kind = 'single_choice' THEN {Q._EXHIBIT} END}},
{{'scan': 'label_only', 'reason': CASE WHEN subject_source = 'original' AND kind <> 'short_response' AND NOT contains(lower(text), substr(subject, 1, 2)) THEN 'subject:' || subject END}}]) AS x FROM p) SELECT doc_id, x.scan AS scan, x.reason AS reason FROM s WHERE x.reason IS NOT NULL""")
def r33_quality_scans(t):
    q = Q._parts(Q._questions(t))
    ready = c("gate").isNull()
    scans = {
        "broken": (ready, P.structure_problem(c("kind"), c("options"), c("stem"))),
        "incomplete": (ready, P.incomplete(F.array("stem"), c("stem"), c("passage"), c("options"), c("visual"))),
        "exhibit": (c("kind") == "single_choice", P.missing_exhibit(c("stem"), c("visual"))),
        "label_only": ((c("subject_source") == "original") & (c("kind") != "short_response"), F.when(~F.contains(F.lower("text"), F.substring("subject", 1, 2)), F.concat(F.lit("subject:"), c("subject")))),
    }
    return R.quality_scans(q, "doc_id", scans)
