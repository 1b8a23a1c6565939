"""Answers, policy, subjects, data quality and evidence on the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import policy as P
from tessera.operators import quality as Q
from tessera.plans.base import query

c = F.col


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p) <> '')) AS paragraphs FROM documents")
def k3_paragraphs(t):
    return t.documents.select("doc_id", F.size(F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != "")).cast("long").alias("paragraphs"))


@query("SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, n_name, 'warn') AS shown FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 15")
def k6_resolution_order(t):
    j = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"), "left").join(t.nation.where("n_nationkey < 15"), c("c_nationkey") == c("n_nationkey"), "left")
    return j.select("o_orderkey", F.coalesce(F.when(c("c_acctbal") > 5000, c("c_name")), "n_name", F.lit("warn")).alias("shown"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN n_chars = 0 THEN 'empty' END, CASE WHEN n_chars > 10000 THEN 'long' END, CASE WHEN contains(text, '@') THEN 'mail' END) AS flags FROM documents")
def k16_derived_flags(t):
    return t.documents.select("doc_id", F.concat_ws(",", P.queues(empty=c("n_chars") == 0, long=c("n_chars") > 10000, mail=c("text").contains("@"))).alias("flags"))


@query("""SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'x' WHEN lang = 'en' THEN 'english' WHEN lang = 'de' AND doc_id % 2 = 0 THEN 'german' ELSE 'general' END AS code,
CASE WHEN doc_id % 50 = 0 THEN 'admin' WHEN lang = 'en' THEN 'original' WHEN lang = 'de' AND doc_id % 2 = 0 THEN 'inferred' ELSE 'unclassified' END AS origin FROM documents""")
def p1_resolve_subject(t):
    alias = F.create_map(*[F.lit(x) for x in ("", "general", "en", "english", "german", "german")])
    null = F.lit(None).cast("string")
    s = P.resolve_subject(F.when(c("doc_id") % 50 == 0, "x"), null, F.lit(False), c("lang"), F.when(c("lang") == "de", "german"), F.when(c("doc_id") % 2 == 0, "high").otherwise("low"), alias, ["", "fr"], ["high", "medium"])
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", c("s.code").alias("code"), c("s.source").alias("origin"))


POLICY = P.Policy(allowed_states=("F", "READY_TO_SERVE"), allowed_types=("1-URGENT", "2-HIGH"), blocking=("render",), allow_self_check=False)
_REASONS = """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 11 <> 0 THEN 'state:' || o_orderstatus END, CASE WHEN o_orderkey % 11 = 1 THEN 'review:blocked' END,
CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'type:' || o_orderpriority END, CASE WHEN o_orderkey % 4 = 0 THEN 'render' END, CASE WHEN o_totalprice > 400000 THEN 'removed_upstream' END, CASE WHEN o_orderkey % 6 = 0 THEN 'scoring:self_check' END) AS reasons FROM orders"""


def _reasons(t):
    flags = F.when(c("o_orderkey") % 4 == 0, F.array(F.lit("render"), F.lit("other"))).otherwise(F.array(F.lit("other")))
    gate = F.when(c("o_orderkey") % 11 == 0, "ready").when(c("o_orderkey") % 11 == 1, "blocked").otherwise("")
    r = P.reasons(POLICY, c("o_orderstatus"), c("o_orderpriority"), flags, c("o_totalprice") > 400000, F.when(c("o_orderkey") % 6 == 0, "self_check").otherwise("auto"), gate)
    return t.orders.select("o_orderkey", r.alias("r"))


@query(_REASONS)
def p2_policy_reasons(t):
    return _reasons(t).select("o_orderkey", F.concat_ws(",", "r").alias("reasons"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN true WHEN o_orderkey % 13 = 1 THEN false ELSE reasons = '' END AS served FROM ({_REASONS})")
def p3_override(t):
    over = F.when(c("o_orderkey") % 13 == 0, "enable").when(c("o_orderkey") % 13 == 1, "disable").otherwise("")
    return _reasons(t).select("o_orderkey", P.served(F.size("r") == 0, over).alias("served"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'signup') THEN 'signup' END AS state FROM events GROUP BY user_id")
def p4_state_priority(t):
    a = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return a.select("user_id", F.get(P.first_by_priority(c("s"), ["error", "purchase", "signup"]), 0).alias("state"))


#: Records by what texts hold: issues of rendering, flags, sources of answers.
_ISSUES = {"formula": "osa", "missing_visual": "ingan", "visual": "heitun", "content": "queí"}
_RECORD_FLAGS = {"encoding_replacement_char": "zzz", "legacy_encoding_mojibake": "ûx", "formula_low_confidence": "esche", "pdf_text_layer_fidelity": "eaule", "missing_solution": "ciónde", "odd_layout": "oulth", "missing_answer": "tionan"}
_HELD = lambda names: "list_filter([" + ", ".join(f"CASE WHEN contains(head, '{w}') THEN '{k}' END" for k, w in names.items()) + "], lambda x: x IS NOT NULL)"
_RECORDS = f"""SELECT doc_id, {_HELD(_ISSUES)} AS issues, {_HELD(_RECORD_FLAGS)} AS flags, CASE WHEN contains(head, 'rr') THEN 'needs_review' WHEN contains(head, 'ßß') THEN 'rejected' ELSE 'accepted' END AS review, CASE WHEN contains(head, 'aux') THEN 'SOURCE_PROVIDED_ANSWER' WHEN contains(head, 'ie') THEN 'UNRESOLVED' WHEN contains(head, 'th') THEN 'SOURCE_PROVIDED_SOLUTION' END AS answer,
contains(head, '@') OR contains(head, 'ver') AS layer, contains(head, 'do') AS maths, contains(head, 'pf') AS figure, contains(head, 'enti') AS rebuilt FROM (SELECT doc_id, substr(text, 1, 400) AS head FROM documents)"""


@query(f"""SELECT doc_id, coalesce(nullif(concat_ws(',', CASE WHEN review = 'rejected' THEN 'REJECTED' END, CASE WHEN list_contains(issues, 'formula') OR (layer AND NOT rebuilt AND maths) THEN 'NEEDS_FORMULA_REVIEW' END, CASE WHEN list_has_any(issues, ['visual', 'missing_visual']) OR (layer AND NOT rebuilt AND figure) THEN 'NEEDS_VISUAL_REVIEW' END,
CASE WHEN answer IS NULL OR answer IN ('UNRESOLVED', 'AUTOMATICALLY_INFERRED_CANDIDATE') THEN 'NEEDS_ANSWER_LINKING' END, CASE WHEN list_contains(issues, 'content') OR list_has_any(flags, ['legacy_encoding_mojibake', 'encoding_replacement_char'])
  OR (review = 'needs_review' AND len(list_filter(flags, lambda f: NOT list_contains(['missing_solution', 'image_dependent', 'missing_answer'], f) AND NOT (rebuilt AND list_contains(['pdf_text_layer_fidelity', 'formula_low_confidence', 'formula_unconverted'], f)))) > 0) THEN 'NEEDS_REVIEW' END), ''), 'READY_TO_SERVE') AS states FROM ({_RECORDS})""")
def p4_editorial_states(t):
    d = t.documents.withColumn("head", F.substring("text", 1, 400))
    holds = lambda w: F.contains("head", F.lit(w))
    held = lambda names: F.array_compact(F.array(*[F.when(holds(w), F.lit(k)) for k, w in names.items()]))
    review = F.when(holds("rr"), "needs_review").when(holds("ßß"), "rejected").otherwise("accepted")
    answer = F.when(holds("aux"), "SOURCE_PROVIDED_ANSWER").when(holds("ie"), "UNRESOLVED").when(holds("th"), "SOURCE_PROVIDED_SOLUTION")
    x = P.editorial_states(review, held(_ISSUES), held(_RECORD_FLAGS), answer, holds("@") | holds("ver"), holds("do"), holds("pf"), holds("enti"))
    return d.select("doc_id", F.array_join(x, ",").alias("states"))



@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE (reasons = '') <> (o_orderkey % 2 = 0)) AS changed FROM ({_REASONS})")
def p5_recompute_changes(t):
    return _reasons(t).agg(F.count("*").alias("total"), F.count_if((F.size("r") == 0) != (c("o_orderkey") % 2 == 0)).alias("changed"))


@query("SELECT l_orderkey, bool_or(f.p_partkey IS NOT NULL) AS failing FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 48) f ON l_partkey = f.p_partkey GROUP BY l_orderkey")
def p8_failing_parts(t):
    bad = t.part.where("p_size > 48").select(c("p_partkey").alias("l_partkey"), F.lit(True).alias("bad"))
    return t.lineitem.join(bad, "l_partkey", "left").groupBy("l_orderkey").agg(F.bool_or(c("bad").isNotNull()).alias("failing"))


_KEY = r"regexp_replace(lower(nfc_normalize({})), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_KEYS = f"""SELECT doc_id, CASE WHEN length(k) >= 40 THEN sha256(k || '#' || array_to_string(list_transform(ls[2:], lambda o: {_KEY.format("o")}), '|')) END AS exact_key, CASE WHEN length(k) >= 40 THEN sha256(k) END AS near_key
FROM (SELECT doc_id, ls, {_KEY.format("ls[1]")} AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


def _keys(t):
    lines = F.split("text", "\n", -1)
    k = Q.duplicate_keys(lines[0], F.slice(lines, 2, F.size(lines)))
    return t.documents.select("doc_id", k.alias("k")).select("doc_id", c("k.exact").alias("exact_key"), c("k.near").alias("near_key"))


@query(_KEYS)
def q2_duplicate_keys(t):
    return _keys(t)


@query(f"""WITH k AS ({_KEYS}), e AS (SELECT exact_key AS k, list_sort(list(doc_id)) AS ids FROM k WHERE exact_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1), n AS (SELECT near_key AS k, list_sort(list(doc_id)) AS ids FROM k WHERE near_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, CASE WHEN e.k IS NOT NULL THEN 'exact_duplicate' ELSE 'near_duplicate' END AS code, array_to_string(list_filter(coalesce(e.ids, n.ids), lambda x: x <> doc_id)[1:5], ',') AS partners
FROM k LEFT JOIN e ON k.exact_key = e.k LEFT JOIN n ON k.near_key = n.k WHERE coalesce(e.k, n.k) IS NOT NULL""")
def q3_duplicate_index(t):
    found = Q.duplicate_index(_keys(t), "doc_id", "exact_key", "near_key")
    return found.select("doc_id", "code", F.array_join(F.transform("partners", lambda x: x.cast("string")), ",").alias("partners"))


@query(f"""WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'dismissed' ELSE 'accepted' END AS s, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE 'old' END AS ph FROM documents WHERE doc_id % 5 < 3),
f AS (SELECT doc_id, sha256(text) AS fh FROM documents WHERE n_chars < 1000)
SELECT coalesce(p.doc_id, f.doc_id) AS doc_id, CASE WHEN f.doc_id IS NOT NULL THEN CASE WHEN s = 'accepted' OR (s = 'dismissed' AND ph = fh) THEN s ELSE 'open' END WHEN s = 'open' THEN 'fixed' ELSE s END AS state, coalesce(fh, ph) AS part_hash FROM p FULL JOIN f ON p.doc_id = f.doc_id""")
def q4_finding_states(t):
    d = t.documents
    state = F.when(c("doc_id") % 3 == 0, "open").when(c("doc_id") % 3 == 1, "dismissed").otherwise("accepted")
    prev = d.where("doc_id % 5 < 3").select("doc_id", state.alias("state"), F.when(c("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("old").alias("part_hash"))
    return Q.finding_states(prev, d.where("n_chars < 1000").select("doc_id", F.sha2("text", 256).alias("part_hash")), ["doc_id"])


@query("SELECT d.doc_id, CASE WHEN quality IS NOT NULL AND d.doc_id % 3 > 0 THEN CASE WHEN quality = 1 THEN 'ok' ELSE 'fail' END WHEN quality IS NOT NULL THEN 'stale' WHEN lang = 'en' THEN 'pending' ELSE 'na' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q5_dimension_status(t):
    j = t.documents.join(t.labels, "doc_id", "left")
    return j.select("doc_id", P.dimension_status(F.when(c("quality") == 1, "ok").when(c("quality") == 0, "fail"), F.when(c("doc_id") % 3 > 0, "a").otherwise("b"), F.lit("a"), c("lang") == "en").alias("status"))


@query("SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'blocked' WHEN quality = 1 AND d.doc_id % 2 = 0 THEN 'ready' WHEN d.doc_id % 2 = 1 AND d.doc_id % 3 = 0 THEN 'ready' END AS gate FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def q6_review_gate(t):
    st = F.array(F.when(c("toxic") == 1, "fail").otherwise("ok"), F.when(c("quality") == 1, "ok").otherwise("pending"))
    return t.documents.join(t.labels, "doc_id").select("doc_id", P.review_gate(st, F.lit(True), c("doc_id") % 2 == 1, F.lit(0), c("doc_id") % 3 == 0).alias("gate"))


@query("SELECT d.doc_id, concat_ws(',', CASE WHEN toxic = 1 THEN 'CONFLICT' END, CASE WHEN quality = 0 THEN 'GENERAL_REVIEW' END, CASE WHEN n_chars < 300 THEN 'INCOMPLETE' END, CASE WHEN toxic = 0 AND quality = 1 THEN 'READY' ELSE 'NOT_READY' END) AS queues FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def q7_queues(t):
    ready = (c("toxic") == 0) & (c("quality") == 1)
    q = P.queues(CONFLICT=c("toxic") == 1, GENERAL_REVIEW=c("quality") == 0, INCOMPLETE=c("n_chars") < 300, READY=ready, NOT_READY=~ready)
    return t.documents.join(t.labels, "doc_id").select("doc_id", F.concat_ws(",", q).alias("queues"))


@query("SELECT d.doc_id, CASE WHEN quality + toxic = 1 THEN 40 ELSE 0 END + CASE WHEN n_chars > 500 THEN 20 ELSE 0 END + CASE WHEN lang <> 'en' THEN 10 ELSE 0 END + CASE WHEN toxic = 1 THEN 30 ELSE 0 END + CASE WHEN d.doc_id % 2 = 0 THEN 15 ELSE 0 END - least(d.doc_id % 5, 3) * 5 AS priority FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def q8_priority(t):
    s = P.priority_score(c("quality") + c("toxic"), c("n_chars") > 500, c("lang") != "en", c("toxic") == 1, c("doc_id") % 2 == 0, c("doc_id") % 5)
    return t.documents.join(t.labels, "doc_id").select("doc_id", s.alias("priority"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR sha256(d.source) <> sha256('src' || (d.doc_id % 20))")
def q9_fingerprint_skip(t):
    j = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", F.lit(True).alias("done")), "doc_id", "left")
    return j.where(c("done").isNull() | (F.sha2("source", 256) != F.sha2(F.concat(F.lit("src"), (c("doc_id") % 20).cast("string")), 256))).select("doc_id")


@query("SELECT source, count(*) AS assigned, count(quality) AS done, count(*) - count(quality) AS remaining FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def q11_assignment_progress(t):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("assigned"), F.count("quality").alias("done")).withColumn("remaining", c("assigned") - c("done"))


@query(r"""WITH w AS (SELECT item_id AS q, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark), d AS (SELECT doc_id AS p, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
qg AS (SELECT DISTINCT q, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT q, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)), dg AS (SELECT DISTINCT p, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT p, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
s AS (SELECT q, p, round(count(*) / max(n)::DOUBLE, 4) AS score FROM qg JOIN dg USING (g) JOIN (SELECT q, count(*) AS n FROM qg GROUP BY q) USING (q) GROUP BY q, p)
SELECT q, p, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, p) AS r FROM s) WHERE r <= 5""")
def e1_trigram_locate(t):
    return Q.trigram_locate(t.benchmark, "item_id", "text", t.documents, "doc_id", "text")


@query("SELECT doc_id, CASE WHEN instr(lower(text), 'the ') > 0 AND instr(substr(lower(text), instr(lower(text), 'the ') + 4), 'and ') BETWEEN 1 AND 3000 THEN true ELSE false END AS ordered FROM documents")
def e2_ordered_substrings(t):
    low = F.lower("text")
    at = F.instr(low, "the ")
    rest = F.instr(F.substr(low, at + 4), F.lit("and "))
    return t.documents.select("doc_id", ((at > 0) & rest.between(1, 3000)).alias("ordered"))


@query(r"""SELECT conv_id, turn, CASE WHEN len(b) = 0 THEN 1.0 ELSE round(len(list_filter(b, lambda w: list_contains(a, w))) / len(b)::DOUBLE, 6) END::DOUBLE AS share
FROM (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(before, '')), '[\p{L}]{2,}') AS a, regexp_extract_all(lower(text), '[\p{L}]{2,}') AS b FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations))""")
def e3_identity_score(t):
    from pyspark.sql import Window

    from tessera.operators.evidence import shared_words

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("before", F.coalesce(before, F.lit(""))).select("conv_id", "turn", F.round(shared_words(c("before"), c("text")), 6).alias("share"))


@query("SELECT sha256(text) AS key, count(*) AS occurrences, count(DISTINCT source) = 1 AS agree FROM documents GROUP BY 1 HAVING count(*) > 1")
def e4_evidence_agreement(t):
    g = t.documents.groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("occurrences"), (F.countDistinct("source") == 1).alias("agree"))
    return g.where("occurrences > 1")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?im)^released under[^\n]*$', '', 'g'), '\n{2,}', chr(10), 'g'), chr(10)) AS clean FROM documents")
def e9_strip_furniture(t):
    x = F.regexp_replace("text", r"(?im)^released under[^\n]*$", "")
    return t.documents.select("doc_id", F.trim(F.regexp_replace(x, r"\n{2,}", "\n"), F.lit("\n")).alias("clean"))


@query("SELECT 'short_toxic' AS batch, d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1 AND n_chars < 1000 UNION ALL SELECT 'long_good', d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 AND n_chars > 5000")
def e12_named_batches(t):
    j = t.documents.join(t.labels, "doc_id")
    batches = F.explode(P.queues(short_toxic=(c("toxic") == 1) & (c("n_chars") < 1000), long_good=(c("quality") == 1) & (c("n_chars") > 5000)))
    return j.select(batches.alias("batch"), "doc_id")


@query(f"SELECT coalesce(reason, 'passed') AS reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 40 THEN 'too_short' WHEN contains(text, '@') THEN 'mail' WHEN lang <> 'en' THEN 'language' END AS reason FROM documents) GROUP BY 1")
def e13_gate_histogram(t):
    first = F.coalesce(F.when(c("n_chars") < 40, "too_short"), F.when(c("text").contains("@"), "mail"), F.when(c("lang") != "en", "language"), F.lit("passed"))
    return t.documents.groupBy(first.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, sha256(split_part(text, ' ', 1) || split_part(text, ' ', 2)) AS k, sha256(text) AS r FROM documents), o AS (SELECT a.doc_id, b.r = a.r AS same, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id) AS i FROM d a JOIN d b ON a.k = b.k AND a.doc_id <> b.doc_id)
SELECT doc_id, count(*)::INT AS siblings, bool_and(same) AS confirmed FROM o WHERE i <= 3 GROUP BY doc_id""")
def e14_cross_edition(t):
    words = F.split("text", " ", -1)
    key = F.sha2(F.concat(words[0], F.coalesce(F.get(words, F.lit(1)), F.lit(""))), 256)
    return Q.confirmed_by_editions(t.documents.select("doc_id", key.alias("key"), F.sha2("text", 256).alias("rebuilt")), "doc_id", "key", "rebuilt")

