"""Scans, filters, joins, aggregations, windows, order and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import filters as P
from tessera.operators.contexts import match_contexts
from tessera.operators.windows import greedy_fill, latest_by, stack_periods
from tessera.plans.base import query
from tessera.sources.jsonl import split_records, validate_records

c = F.col


@query("SELECT o_orderkey, o_orderstatus, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000")
def s1_snapshot_scan(t):
    return t.orders.where("o_totalprice > 100000").join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).select("o_orderkey", "o_orderstatus", "n_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey")
def s2_key_range_scan(t):
    return t.orders.where("o_orderkey > 500").select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


@query("SELECT * FROM customer WHERE c_custkey IN (1, 7, 42, 99)")
def s3_point_lookup(t):
    return t.customer.where(c("c_custkey").isin(1, 7, 42, 99))


@query("SELECT o_orderkey, count(l_orderkey) AS n_items, coalesce(string_agg(l_linenumber || ':' || l_returnflag || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_returnflag, l_partkey, l_suppkey), '') AS items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def s4_nested_fetch(t):
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_partkey", "l_suppkey"))).alias("xs"))
    row = lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"], x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))
    xs = F.coalesce("xs", F.array().cast("array<struct<l_linenumber:int,l_returnflag:string,l_partkey:bigint,l_suppkey:bigint>>"))
    return t.orders.join(items, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", F.size(xs).cast("long").alias("n_items"), F.array_join(F.transform(xs, row), ",").alias("items"))


@query("SELECT event_id AS line_no, props, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 7 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL")
def s8_jsonl_good_records(t):
    lines = t.events.select(c("event_id").alias("line_no"), F.when(c("event_id") % 7 == 0, F.concat(F.lit("{broken "), "props")).otherwise(c("props")).alias("value"))
    good, _ = split_records(lines, "k long")
    return good.where("k is not null").select("line_no", c("value").alias("props"), "k")


@query("SELECT event_id AS line_no, 'unreadable record' AS error FROM events WHERE event_id % 7 = 0")
def s8_jsonl_bad_records(t):
    lines = t.events.select(c("event_id").alias("line_no"), F.when(c("event_id") % 7 == 0, F.concat(F.lit("{broken "), "props")).otherwise(c("props")).alias("value"))
    return split_records(lines, "k long")[1].select("line_no", F.lit("unreadable record").alias("error"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN text IS NULL OR trim(text) = '' THEN 'text missing' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'lang not allowed' END, CASE WHEN r.r_name IS NULL THEN 'source unknown' END) AS errors FROM documents LEFT JOIN (SELECT 'src' || r_regionkey AS r_name FROM region) r ON source = r.r_name")
def s9_validate_records(t):
    known = t.region.select(F.concat(F.lit("src"), c("r_regionkey").cast("string")).alias("name"))
    return validate_records(t.documents, required=["text"], allowed={"lang": ["en", "de"]}, known={"source": known}).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT e.event_id, coalesce(json_extract_string(props, '$.k'), c_name, 'none') AS detail FROM events e LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'error'")
def s10_deferred_scan(t):
    return t.events.where("event_type = 'error'").join(t.customer, c("user_id") == c("c_custkey"), "left").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), "c_name", F.lit("none")).alias("detail"))


@query("SELECT sha256(text) AS sha, substr(sha256(text), 1, 2) || '/' || sha256(text) || '.txt' AS path, min(doc_id) AS first_doc, count(*) AS uses FROM documents GROUP BY 1, 2")
def s11_content_addresses(t):
    sha = F.sha2("text", 256)
    return t.documents.groupBy(sha.alias("sha")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("uses")).withColumn("path", F.concat(F.substring("sha", 1, 2), F.lit("/"), "sha", F.lit(".txt")))


@query("""SELECT '{"id":' || o_orderkey || ',"user":' || CASE WHEN c_acctbal > 0 THEN '"' || c_name || '"' ELSE 'null' END || '}' AS line FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'""")
def s12_jsonl_export(t):
    rows = t.orders.where("o_orderstatus = 'P'").join(t.customer, c("o_custkey") == c("c_custkey"), "left")
    return rows.select(F.to_json(F.struct(c("o_orderkey").alias("id"), F.when(c("c_acctbal") > 0, c("c_name")).alias("user")), {"ignoreNullFields": "false"}).alias("line"))


@query("WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{9,}')) AS formula FROM documents) SELECT DISTINCT formula FROM f WHERE formula NOT IN (SELECT formula FROM f WHERE doc_id IN (SELECT doc_id FROM labels))")
def s13_unchecked_export(t):
    found = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{9,}"), F.lit(0))).alias("formula"))
    return found.select("formula").distinct().join(found.join(t.labels, "doc_id", "left_semi").select("formula").distinct(), "formula", "left_anti")


@query("SELECT o_orderkey, CASE WHEN l.k IS NULL THEN o_totalprice ELSE -1.0 END AS value FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 49) l ON o_orderkey = l.k")
def s14_upsert_by_hash(t):
    from tessera.operators.cdc import upsert

    new = t.lineitem.where("l_quantity > 49").select(c("l_orderkey").alias("o_orderkey"), F.lit(-1.0).alias("value")).distinct()
    return upsert(t.orders.select("o_orderkey", c("o_totalprice").alias("value")), new, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 10000 AND 200000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def f1_optional_conjuncts(t):
    want = P.all_of(P.equals("o_orderstatus", "F"), P.equals("o_custkey", None), P.between("o_totalprice", 10000, 200000), P.day_range("o_orderdate", "1996-01-01", "1996-12-31"), c("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return t.orders.where(want).select("o_orderkey")


@query("SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 AND toxic = 0 AND n_chars >= 500 AND lower(text) LIKE '%th%'")
def f2_review_queue_filter(t):
    want = P.all_of(P.equals("quality", 1), P.equals("toxic", 0), P.between("n_chars", 500), P.contains_text("text", "TH"), P.equals("source", None))
    return t.documents.join(t.labels, "doc_id").where(want).select("doc_id")


@query("SELECT d.doc_id, quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR quality = 0")
def f3_null_sentinel(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    return d.where(P.equals("quality", P.NONE) | P.equals("quality", 0)).select("doc_id", c("quality").isNull().alias("unlabelled"))


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def f4_in_not_in(t):
    return t.part.where(c("p_size").isin(1, 2, 3) & ~c("p_brand").isin("Brand#11", "Brand#12")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE 'customer#0000000%' OR c_mktsegment ILIKE '%build%'")
def f5_ilike(t):
    return t.customer.where(c("c_name").ilike("customer#0000000%") | P.contains_text("c_mktsegment", "BUILD")).select("c_custkey")


@query("""WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS ev FROM events GROUP BY user_id)
SELECT user_id, list_contains(ev, 'error') AS any_error, list_has_all(ev, ['click', 'view']) AS has_both, list_has_any(ev, ['purchase', 'signup']) AS has_one, list_has_all(['click', 'view', 'error', 'purchase'], ev) AS inside FROM a""")
def f6_array_predicates(t):
    a = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("ev"))
    return a.select("user_id", F.array_contains("ev", "error").alias("any_error"), P.contains_all("ev", ["click", "view"]).alias("has_both"), P.overlaps("ev", ["purchase", "signup"]).alias("has_one"), P.contained_by("ev", ["click", "view", "error", "purchase"]).alias("inside"))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1 AND min(l_returnflag) = 'N'")
def f7_array_equality(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("v")).where(c("v") == F.array(F.lit("N"))).select("l_orderkey")


@query(r"SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(text, chr(10))) AS l) WHERE NOT regexp_matches(l, '^.{0,400}$'))")
def f8_no_element_fails(t):
    return t.documents.where(F.forall(F.split("text", "\n"), lambda x: x.rlike("^.{0,400}$"))).select("doc_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k')::INT < 10")
def f9_json_path(t):
    k = F.get_json_object("props", "$.k")
    return t.events.where(k.cast("int") < 10).select("event_id", k.alias("k"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM l.toxic")
def f10_distinct_from(t):
    return t.documents.join(t.labels, "doc_id", "left").where(~c("quality").eqNullSafe(c("toxic"))).select("doc_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06'")
def f11_day_range(t):
    return t.events.where(P.day_range("ts", "2024-01-03", "2024-01-05")).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 50000 AND o_totalprice <= 60000")
def f12_numeric_range(t):
    return t.orders.where(P.between("o_totalprice", 50000, 60000)).select("o_orderkey")


@query("SELECT 'digits' AS kind, doc_id FROM documents WHERE doc_id = 12 UNION ALL SELECT 'prefix', doc_id FROM documents WHERE doc_id::VARCHAR LIKE '12%' UNION ALL SELECT 'text', doc_id FROM documents WHERE text ILIKE '%license%'")
def f13_search_dispatch(t):
    one = lambda kind, term: t.documents.where(P.search(term, "doc_id", "text")).select(F.lit(kind).alias("kind"), "doc_id")
    return one("digits", "12").union(one("prefix", "#12")).union(one("text", "License"))


@query("SELECT p_partkey FROM part WHERE replace(p_name, ' ', '') ILIKE '%DwId%'")
def f14_space_insensitive(t):
    return t.part.where(F.replace("p_name", F.lit(" "), F.lit("")).ilike("%DwId%")).select("p_partkey")


@query("SELECT conv_id, turn FROM conversations WHERE (role || ' ' || text) LIKE '%user%'")
def f15_full_document_text(t):
    return t.conversations.where(F.concat_ws(" ", "role", "text").contains("user")).select("conv_id", "turn")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def f16_pruned_projection(t):
    return t.documents.where("lang = 'fr'").select("doc_id", "lang")


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '[\x20\t\n\r]+', ' ', 'g')), 1, 200) AS preview FROM documents")
def f17_preview(t):
    return t.documents.select("doc_id", F.substring(F.trim(F.regexp_replace("text", r"[\x20\t\n\r]+", " ")), 1, 200).alias("preview"))


@query("SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]{1,6}$') THEN substr(source, 4)::INT ELSE 0 END AS number FROM documents")
def f18_guarded_cast(t):
    return t.documents.select("doc_id", F.when(c("source").rlike("^src[0-9]{1,6}$"), F.substring("source", 4, 6).try_cast("int")).otherwise(0).alias("number"))


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 10")
def j1_inner_equi(t):
    return t.lineitem.join(t.part.where("p_size = 10"), c("l_partkey") == c("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT o_orderpriority, p_brand, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def j2_star_join(t):
    j = t.lineitem.join(t.orders.where("o_orderstatus = 'F'"), c("l_orderkey") == c("o_orderkey")).join(t.part, c("l_partkey") == c("p_partkey"))
    return j.groupBy("o_orderpriority", "p_brand").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS submitted FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def j3_left_with_on_predicate(t):
    return t.customer.join(t.orders, (c("o_custkey") == c("c_custkey")) & (c("o_orderstatus") == "F"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("submitted"))


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j4_left_outer(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j5_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j6_anti(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS has_big FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_extendedprice > o_totalprice / 10)")
def j7_exists(t):
    bad = (c("l_orderkey") == c("o_orderkey")) & (c("l_returnflag") == "R") & (c("l_extendedprice") > c("o_totalprice") / 10)
    o = t.orders.join(t.lineitem, bad, "left_anti")
    big = t.lineitem.where("l_quantity > 45").select(c("l_orderkey").alias("k")).distinct()
    return o.join(big, c("o_orderkey") == c("k"), "left").select("o_orderkey", c("k").isNotNull().alias("has_big"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) END AS label FROM supplier")
def j8_scalar_lookup(t):
    return t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey"), "left").select("s_suppkey", F.when(c("s_acctbal") < 0, "debt").otherwise(c("n_name")).alias("label"))


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.doc_id // 2 END, d.doc_id)")
def j9_coalesced_key(t):
    d = t.documents.select("doc_id", F.coalesce(F.when(c("doc_id") % 2 == 0, (c("doc_id") / 2).cast("long")), "doc_id").alias("k"))
    return d.join(t.labels.select(c("doc_id").alias("k"), "quality"), "k").select("doc_id", "quality")


@query("SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND a.role = b.role")
def j10_self_join(t):
    a, b = t.conversations.select("conv_id", "role", c("turn").alias("turn_a")), t.conversations.select("conv_id", "role", c("turn").alias("turn_b"))
    return a.join(b, ["conv_id", "role"]).where("turn_a <> turn_b").select("conv_id", "turn_a", "turn_b")


@query("SELECT e.event_id, p.event_id AS period FROM events e JOIN events p ON e.user_id = p.user_id AND p.event_type = 'signup' AND p.ts <= e.ts AND e.ts < p.ts + INTERVAL 1 DAY WHERE e.event_type = 'purchase'")
def j11_point_in_period(t):
    p = t.events.where("event_type = 'signup'").select("user_id", c("event_id").alias("period"), c("ts").alias("starts"))
    return t.events.where("event_type = 'purchase'").join(p, "user_id").where((c("starts") <= c("ts")) & (c("ts") < c("starts") + F.expr("INTERVAL 1 DAY"))).select("event_id", "period")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey < 200")
def j12_dict_join(t):
    return t.orders.where("o_orderkey < 200").join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'label_missing' END AS problem FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j13_lookup_default(t):
    l = t.labels.select("doc_id", "quality", F.lit(True).alias("hit"))
    return t.documents.join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(c("hit").isNull(), "label_missing").alias("problem"))


@query("SELECT a.conv_id, a.turn, b.turn AS reply FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn AND length(a.text) >= 8 AND length(b.text) >= 8 AND (right(a.text, 1) = right(b.text, 1)) AND left(lower(a.text), 1) = left(lower(b.text), 1)")
def j14_fuzzy_context(t):
    a = t.conversations.where(F.length("text") >= 8).select("conv_id", "turn", F.lower(F.left("text", F.lit(1))).alias("h"), F.right("text", F.lit(1)).alias("z"))
    b = a.withColumnRenamed("turn", "reply")
    return a.join(b, ["conv_id", "h", "z"]).where("turn < reply").select("conv_id", "turn", "reply")


@query(r"""WITH n AS (SELECT conv_id, turn, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, turn % 3 AS m, regexp_replace(lower(nfc_normalize(coalesce(before, ''))), '[\s\x0B\x1C-\x1F\x85\p{Z}]+', '', 'g') AS b, regexp_replace(lower(nfc_normalize(coalesce(after, ''))), '[\s\x0B\x1C-\x1F\x85\p{Z}]+', '', 'g') AS a FROM n),
p AS (SELECT conv_id, turn, right(b, 16) AS pa, left(a, 16) AS pb FROM s),
l AS (SELECT conv_id, turn, right(b, 16) AS da, CASE WHEN m = 0 THEN 'câu' || turn || ':' || a ELSE a END AS t FROM s),
d AS (SELECT conv_id, turn, da, unnest([left(t, 16), left(regexp_replace(t, '^(?:câu|question|bài)?\p{Nd}{1,3}[.:)]', ''), 16)]) AS db FROM l)
SELECT DISTINCT p.conv_id, p.turn AS place, d.turn AS drawing FROM p JOIN d ON p.conv_id = d.conv_id
 AND right(pa, least(length(pa), length(da))) = right(da, least(length(pa), length(da)))
 AND left(pb, least(length(pb), length(db))) = left(db, least(length(pb), length(db)))
 AND greatest(least(length(pa), length(da)), least(length(pb), length(db))) >= 8""")
def j14_context_match(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = t.conversations.select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))
    labelled = F.when(c("turn") % 3 == 0, F.concat(F.lit("Câu "), "turn", F.lit(": "), F.coalesce("after", F.lit("")))).otherwise(c("after"))
    drawings = near.select("conv_id", c("turn").alias("drawing"), "before", labelled.alias("after"))
    return match_contexts(near.withColumnRenamed("turn", "place"), drawings, "conv_id")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def a1_count_by_key(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source ORDER BY lang, source")
def a2_two_keys(t):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy("lang", "source")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS large, count(*) FILTER (WHERE user_id < 10 AND event_type = 'view') AS early_views FROM events")
def a3_filtered_counts(t):
    return t.events.agg(F.count("*").alias("n"), F.count_if(c("event_type") == "click").alias("clicks"), F.count_if(c("event_type") == "error").alias("errors"), F.count_if(c("value") > 50).alias("large"), F.count_if((c("user_id") < 10) & (c("event_type") == "view")).alias("early_views"))


@query("SELECT p_type, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS correct, sum(CASE WHEN l_returnflag IN ('N', 'R') THEN 1 ELSE 0 END)::BIGINT AS graded FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def a4_conditional_sums(t):
    one = lambda p: F.sum(F.when(p, 1).otherwise(0))
    return t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).groupBy("p_type").agg(one(c("l_returnflag") == "N").alias("correct"), one(c("l_returnflag").isin("N", "R")).alias("graded"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a5_count_distinct(t):
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("SELECT coalesce(round(sum(coalesce(CASE WHEN l_discount > 0.05 THEN l_extendedprice END, 0)), 2), 0) AS revenue FROM lineitem WHERE l_linestatus = 'O'")
def a6_revenue(t):
    x = F.coalesce(F.when(c("l_discount") > 0.05, c("l_extendedprice")), F.lit(0.0))
    return t.lineitem.where("l_linestatus = 'O'").agg(F.coalesce(F.round(F.sum(x), 2), F.lit(0.0)).alias("revenue"))


@query("SELECT l_returnflag, round(avg(l_extendedprice / nullif(floor(l_quantity / 10), 0)), 6) AS mean_ratio FROM lineitem GROUP BY l_returnflag")
def a7_mean_ratio(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg(c("l_extendedprice") / F.nullif(F.floor(c("l_quantity") / 10), F.lit(0))), 6).alias("mean_ratio"))


@query("SELECT o_custkey, max(o_orderdate) AS last_seen, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS last_done FROM orders GROUP BY o_custkey")
def a8_max_per_group(t):
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_seen"), F.max(F.when(c("o_orderstatus") == "F", c("o_orderdate"))).alias("last_done"))


@query("SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def a9_duplicate_keys(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') >= 0.5 * count(*)")
def a10_ratio_gate(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "F").alias("f")).where("f >= 0.5 * n").select("o_custkey", "n")


@query("SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 20 DAY GROUP BY 1, 2")
def a11_daily_counts(t):
    return t.events.where(c("ts") >= F.to_timestamp(F.lit("2024-01-30")) - F.expr("INTERVAL 20 DAY")).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w")
def a12_unnest_histogram(t):
    return t.part.select(F.explode(F.split("p_type", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS band, count(*) AS n FROM documents GROUP BY 1")
def a13_computed_key(t):
    band = F.when(c("n_chars") < 500, "short").when(c("n_chars") < 5000, "middle").otherwise("long")
    return t.documents.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_returnflag AS up, l_linestatus AS eff, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT k, coalesce(sum(a), 0)::BIGINT AS upstream, coalesce(sum(b), 0)::BIGINT AS effective, coalesce(sum(m), 0)::BIGINT AS moved_out FROM (SELECT up AS k, n AS a, 0 AS b, CASE WHEN up <> eff THEN n ELSE 0 END AS m FROM p UNION ALL SELECT eff, 0, n, 0 FROM p) GROUP BY k""")
def a14_two_sided_buckets(t):
    p = t.lineitem.groupBy(c("l_returnflag").alias("up"), c("l_linestatus").alias("eff")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    both = p.select(c("up").alias("k"), c("n").alias("a"), zero.alias("b"), F.when(c("up") != c("eff"), c("n")).otherwise(0).alias("m")).union(p.select("eff", zero, "n", zero))
    return both.groupBy("k").agg(F.sum("a").alias("upstream"), F.sum("b").alias("effective"), F.sum("m").alias("moved_out"))


@query("""SELECT total, tiny, licensed, sources, sample FROM (SELECT count(*) AS total, count(*) FILTER (WHERE n_chars < 100) AS tiny, count(*) FILTER (WHERE text LIKE '%license%') AS licensed, count(DISTINCT source) AS sources FROM documents),
(SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS sample FROM (SELECT doc_id FROM documents WHERE n_chars < 400 ORDER BY doc_id LIMIT 50))""")
def a15_profile(t):
    counts = t.documents.agg(F.count("*").alias("total"), F.count_if(c("n_chars") < 100).alias("tiny"), F.count_if(c("text").contains("license")).alias("licensed"), F.countDistinct("source").alias("sources"))
    first = t.documents.where(c("n_chars") < 400).select("doc_id").orderBy("doc_id").limit(50)  # a report's sample: Spark takes the top 50 of each task
    sample = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("sample"))
    null = F.lit(None)
    rows = counts.select("*", null.cast("string").alias("sample")).union(sample.select(*[null.cast("long")] * 4, "sample"))
    return rows.agg(*[F.max(k).alias(k) for k in ("total", "tiny", "licensed", "sources", "sample")])


@query("SELECT event_type, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS first_ids FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 20 GROUP BY event_type")
def a16_capped_samples(t):
    first = t.events.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))).where("r <= 20")
    return first.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("first_ids"))


@query("SELECT coalesce(o_orderstatus, 'all') AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus)")
def a17_totals_row(t):
    return t.orders.rollup("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "n", "total")


@query("SELECT p_brand, round(count(*) FILTER (WHERE l_returnflag = 'N') / nullif(count(*) FILTER (WHERE l_returnflag IN ('N', 'R')), 0)::DOUBLE, 3) AS accuracy FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def a18_guarded_ratio(t):
    j = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).groupBy("p_brand")
    return j.agg(F.round(F.try_divide(F.count_if(c("l_returnflag") == "N"), F.count_if(c("l_returnflag").isin("N", "R"))), 3).alias("accuracy"))


@query("SELECT conv_id, string_agg(turn || '=' || role, ';' ORDER BY turn) AS units FROM conversations GROUP BY conv_id")
def a19_group_to_list(t):
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("u"))
    return g.select("conv_id", F.array_join(F.transform("u", lambda x: F.concat_ws("=", x["turn"].cast("string"), x["role"])), ";").alias("units"))


@query("""WITH a AS (SELECT item_id, ch, count(*) AS n FROM (SELECT item_id, unnest(string_split(lower(text), '')) AS ch FROM benchmark) WHERE ch <> ' ' GROUP BY 1, 2),
b AS (SELECT ch, sum(n) AS n FROM a WHERE item_id = 0 GROUP BY ch), s AS (SELECT item_id, sum(n) AS total FROM a GROUP BY item_id)
SELECT a.item_id, round(sum(least(a.n, b.n)) / max(total)::DOUBLE, 6) AS share FROM a JOIN b USING (ch) JOIN s ON s.item_id = a.item_id GROUP BY a.item_id""")
def a20_multiset_overlap(t):
    from tessera.operators.quality import multiset_share

    return multiset_share(t.benchmark, "item_id", "text", t.benchmark.where("item_id = 0").select("text"))


@query("SELECT count(quality) >= 0.3 * count(*) AS covered, round(count(quality) / count(*)::DOUBLE, 4) AS share FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def a21_coverage_gate(t):
    return t.documents.join(t.labels, "doc_id", "left").agg(F.count("quality").alias("q"), F.count("*").alias("n")).select((c("q") >= 0.3 * c("n")).alias("covered"), F.round(c("q") / c("n"), 4).alias("share"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def w1_latest_per_key(t):
    return latest_by(t.events, ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_no FROM orders")
def w2_next_version(t):
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("version_no"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS position FROM conversations")
def w3_positions(t):
    return t.conversations.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("role", "turn")).alias("position"))


@query("""WITH RECURSIVE u AS (SELECT o_custkey AS pool, o_orderkey AS unit, (o_orderkey % 7 + 1)::BIGINT AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey) AS r FROM orders),
f AS (SELECT pool, unit, r, size AS used, size <= 12 AS taken FROM u WHERE r = 1 UNION ALL SELECT u.pool, u.unit, u.r, CASE WHEN f.used + u.size <= 12 THEN f.used + u.size ELSE f.used END, f.used + u.size <= 12 FROM f JOIN u ON u.pool = f.pool AND u.r = f.r + 1)
SELECT pool, unit FROM f WHERE taken""")
def w4_greedy_budget(t):
    u = t.orders.select(c("o_custkey").alias("pool"), c("o_orderkey").alias("unit"), (c("o_orderkey") % 7 + 1).alias("size"), F.sha2(c("o_orderkey").cast("string"), 256).alias("h"))
    return greedy_fill(u, ["pool"], "unit", "size", ["h", "unit"], 12).select("pool", "unit")


@query("""WITH RECURSIVE p AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, event_id, r, ts AS starts_at, ts + INTERVAL 3 DAY AS expires_at FROM p WHERE r = 1 UNION ALL SELECT p.user_id, p.event_id, p.r, greatest(p.ts, f.expires_at), greatest(p.ts, f.expires_at) + INTERVAL 3 DAY FROM f JOIN p ON p.user_id = f.user_id AND p.r = f.r + 1)
SELECT user_id, event_id, starts_at, expires_at FROM f""")
def w5_stacked_periods(t):
    return stack_periods(t.events.where("event_type = 'purchase'"), "user_id", "event_id", "ts", days=3)


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w6_neighbours(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))


@query("SELECT p_brand, l_orderkey FROM (SELECT p_brand, l_orderkey, row_number() OVER (PARTITION BY p_brand ORDER BY l_orderkey) AS r FROM (SELECT DISTINCT p_brand, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE r <= 3")
def w7_first_three(t):
    d = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select("p_brand", "l_orderkey").distinct()
    return d.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("l_orderkey"))).where("r <= 3").drop("r")


@query("SELECT c_custkey, 21 + row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20)")
def w8_rank_in_page(t):
    p = P.page(t.customer, [F.desc("c_acctbal"), "c_custkey"], 3, 10)
    rows = p.agg(F.array_sort(F.collect_list(F.struct((-c("c_acctbal")).alias("k"), "c_custkey"))).alias("xs"))
    return rows.select(F.posexplode("xs").alias("i", "x")).select("x.c_custkey", (c("i") + 21).cast("long").alias("rank"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50)")
def l1_page_with_total(t):
    total = t.orders.agg(F.count("*").alias("total"))
    return P.page(t.orders, [F.desc("o_totalprice"), "o_orderkey"], 3, 25).select("o_orderkey").join(F.broadcast(total))


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 100")
def l2_multi_key_sort(t):
    return t.part.orderBy("p_brand", F.desc("p_size"), "p_partkey").limit(100).select("p_partkey", "p_brand", "p_size")


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality ASC NULLS LAST, d.doc_id LIMIT 300")
def l3_nulls_last(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").orderBy(c("quality").asc_nulls_last(), "doc_id").limit(300)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) > (10, 300) ORDER BY o_custkey, o_orderkey LIMIT 40")
def l4_keyset_page(t):
    return t.orders.where(P.after([("o_custkey", 10, False), ("o_orderkey", 300, False)])).orderBy("o_custkey", "o_orderkey").limit(40).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def l5_top_k(t):
    return t.orders.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("r <= 5").select("o_custkey", "o_orderkey")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def l6_histogram_order(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY r_regionkey DESC, n_name")
def l7_dimension_order(t):
    return t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).orderBy(F.desc("r_regionkey"), "n_name").select("n_name", "r_name")


@query("SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def x1_difference_both_ways(t):
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id").distinct()
    one = lambda name, x, y: x.join(y, "doc_id", "left_anti").select(F.lit(name).alias("side"), "doc_id")
    return one("missing", a, b).union(one("extra", b, a))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def x2_union_of_pools(t):
    return t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT sha256(source) FROM documents WHERE lang = 'en' INTERSECT SELECT DISTINCT sha256(source) FROM documents WHERE lang = 'de')")
def x3_distinct_intersection(t):
    h = lambda lang: t.documents.where(c("lang") == lang).select(F.sha2("source", 256).alias("h")).distinct()
    return h("en").join(h("de"), "h", "left_semi").agg(F.count("*").alias("shared"))


@query("SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def x4_backfill(t):
    new = t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return t.labels.select("doc_id", "quality", "toxic").union(new)


@query(r"SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]{3,}')) AS formula FROM documents")
def x5_distinct_extracts(t):
    return t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("([0-9]{3,})"), 1)).alias("formula")).distinct()
