"""Subjects, flags and furniture of the documents' texts; lists and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import content_checks as K
from tessera.plans.base import query

c = F.col


def _swapped(column, pairs):
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def _swap_sql(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


def _re2(p: str) -> str:
    return p.replace("(?iu)", "(?i)").replace("'", "''")


_HEADINGS = [("the", "Vật lí"), ("ung", "Khoa học"), ("que", "TOÁN"), ("ción", "Lịch sử"), ("ment", " hoặc "), ("and", "English"), ("eau", "Ngữ văn")]
_HEAD = _swap_sql("substr(text, 1, 24)", _HEADINGS)
_NAMED = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(h, '{k}')" for k in ks) + f" THEN '{s}' END" for s, ks in K.SECTION_SUBJECTS) + "], lambda x: x IS NOT NULL)"
_OWN = " OR ".join(f"contains(h, '{k}')" for _, ks in K.SECTION_SUBJECTS[:7] for k in ks)


@query(f"SELECT doc_id, CASE WHEN NOT (contains(h, ' hoặc ') OR len({_NAMED}) > 1 OR (contains(h, 'khoa học') AND NOT ({_OWN}))) THEN {_NAMED}[1] END AS subject FROM (SELECT doc_id, lower({_HEAD}) AS h FROM documents)")
def c25_section_subject(t):
    return t.documents.select("doc_id", K.section_subject(_swapped(F.substring("text", 1, 24), _HEADINGS)).alias("subject"))


_LEXICONS = {"license": ["license", "released under", "copyright"], "spanish": ["que", "de la", "ciudad", "para"], "german": ["und", "die", "der", "zu"], "french": ["le", "de", "les", "une", "pour"]}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(regexp_replace(lower(text), '([^\\p{{L}}\\p{{N}}_]+)', ' \\1 ', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(w.replace(' ', '[^\\p{L}\\p{N}_]{1,3}') for w in sorted(ws, key=len, reverse=True))})(?:$|[^\\p{{L}}\\p{{N}}_])')) AS {s}" for s, ws in _LEXICONS.items() if s != "license") + f""",
CASE WHEN len(ts) > {K.ENGLISH_FROM} THEN len(list_filter(ts, lambda w: list_contains({list(K.ENGLISH_WORDS)}, w))) // 2 ELSE 0 END AS english FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]+') AS ts FROM documents)""")
def c24_subject_scores(t):
    lexicons = {s: ws for s, ws in _LEXICONS.items() if s != "license"}
    d = t.documents.select("doc_id", K.subject_scores(c("text"), lexicons).alias("s"))
    return d.select("doc_id", *[F.get("s", F.lit(i))["score"].cast("long").alias(n) for i, n in enumerate([*lexicons, "english"])])


_FORMULAS = [(" the ", " phương trình "), (" de ", " Đồ thị "), (" der ", " bảng sau "), (" que ", " véctơ ")]
_STEM = _swap_sql("substr(text, 1, 60)", _FORMULAS)


@query(f"SELECT doc_id, CASE WHEN n_chars % 4 <> 0 THEN nullif(lower(regexp_extract({_STEM}, '{_re2(K.FORMULA_OBJECTS)}', 1)), '') END AS lost FROM documents")
def c23_lost_formula(t):
    return t.documents.select("doc_id", K.lost_formula(_swapped(F.substring("text", 1, 60), _FORMULAS), c("n_chars") % 4 == 0).alias("lost"))


_PAGES = [(" the ", "\nHẾT\n"), (" de ", "\n ĐỀ THI  THAM KHẢO \n"), (" und ", " Trang 12\n"), (" la ", "\nKIỂM TRA HỌC KÌ I ĐỀ SỐ 4\n"), (" of ", "\nTrang - 7 "), (" le ", "\nPHẦN 2 "), (" que ", " Read the passage "), (" in ", "\n1.2 TOÁN HỌC\n")]
_BODY = "string_split(" + _swap_sql("substr(text, 1, 400)", [(o, n.replace("\n", "' || chr(10) || '")) for o, n in _PAGES]) + ", chr(10))"
_TIDY = "trim(regexp_replace(x, '\\s+', ' ', 'g'))"


@query(f"""WITH b AS (SELECT doc_id, {_BODY} AS ls FROM documents), k AS (SELECT doc_id, ls, coalesce(list_min(list_filter(list_transform(ls, lambda x, i: CASE WHEN regexp_matches({_TIDY}, '{K.NEXT_TEST}') THEN i END), lambda i: i IS NOT NULL)) - 1, len(ls)) AS cut FROM b),
s AS (SELECT doc_id, ls, list_transform(list_filter(ls[1:cut], lambda x: NOT regexp_matches({_TIDY}, '{K.FURNITURE_LINE}')), lambda x: regexp_replace(x, '{K.PAGE_FOOTER}', '', 'g')) AS clean FROM k)
SELECT doc_id, array_to_string(clean, '|') AS clean, clean <> ls AS changed FROM s""")
def e9_furniture_lines(t):
    d = t.documents.select("doc_id", K.strip_furniture(F.split(_swapped(F.substring("text", 1, 400), _PAGES), "\n", -1)).alias("x"))
    return d.select("doc_id", F.array_join("x.lines", "|").alias("clean"), c("x.changed").alias("changed"))


@query(f"""WITH b AS (SELECT doc_id, {_BODY} AS ls FROM documents), k AS (SELECT doc_id, ls, coalesce(list_min(list_filter(list_transform(ls, lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '{K.SECTION_HEAD}') THEN i END), lambda i: i IS NOT NULL)) - 1, len(ls)) AS cut FROM b)
SELECT doc_id, array_to_string(list_transform(ls[1:cut], lambda x: CASE WHEN regexp_matches(x, '{K.PASSAGE_TAIL}') THEN rtrim(regexp_replace(x, '{K.PASSAGE_TAIL}', '')) ELSE x END), '|') AS option FROM k""")
def e9_option_tails(t):
    return t.documents.select("doc_id", F.array_join(K.strip_option(F.split(_swapped(F.substring("text", 1, 400), _PAGES), "\n", -1)), "|").alias("option"))


#: Questions of lines: stems, options, labels and answers by what the lines hold.
_STORED = """SELECT doc_id, CASE WHEN length(ls[1]) % 7 = 0 THEN '  ' ELSE ls[1] END AS stem, contains(ls[1], 'que') AS figure, contains(ls[1], 'die') AS multi, CASE WHEN contains(ls[2], 'ung') THEN ['p'] ELSE [] END AS problems, length(ls[1]) - length(replace(ls[1], ',', '')) AS warns,
CASE WHEN length(ls[1]) % 3 > 0 THEN 'choice' ELSE 'text' END AS kind, list_transform(ls[2:4], lambda o: CASE WHEN length(o) % 5 = 0 THEN '' ELSE o END) AS options, list_transform(ls[2:4], lambda o, i: chr(64 + i::INT)) AS labels, length(ls[1]) % 4 = 0 AS grouped, CASE WHEN contains(text, ' la ') THEN ls[-1] END AS passage, length(ls[1]) % 8 = 0 AS instruction,
CASE WHEN n_chars % 3 = 0 THEN 'choice' WHEN n_chars % 3 = 1 THEN 'text' END AS akind, [chr(65 + (n_chars % 5)::INT)] AS wanted, n_chars % 2 = 0 AS letter FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)"""


@query(f"""SELECT doc_id, concat_ws(',', CASE WHEN trim(stem) = '' AND NOT figure AND NOT multi THEN 'empty_stem' END, CASE WHEN multi AND len(problems) > 0 THEN 'parts_incomplete' END, CASE WHEN kind = 'choice' AND len(options) < 2 THEN 'too_few_options' END, CASE WHEN kind = 'choice' AND list_contains(options, '') THEN 'empty_option' END,
CASE WHEN grouped AND coalesce(passage, '') = '' AND NOT instruction THEN 'group_context_missing' END, CASE WHEN warns > 0 THEN 'render_warning' END, CASE WHEN len(options) = 0 AND letter THEN 'letter_answer_without_options' END, CASE WHEN akind = 'choice' AND len(labels) = 0 THEN 'answer_without_options' END, CASE WHEN akind = 'choice' AND len(labels) > 0 AND NOT list_has_all(labels, wanted) THEN 'answer_not_in_options' END) AS flags FROM ({_STORED})""")
def k16_content_flags(t):
    d = t.documents.withColumn("ls", F.split("text", "\n", -1))
    first, n, k = F.get("ls", F.lit(0)), F.length(F.get("ls", F.lit(0))), c("n_chars")
    opts = F.slice("ls", 2, 3)
    strings = F.array().cast("array<string>")
    q = d.select("doc_id", F.when(n % 7 == 0, "  ").otherwise(first).alias("stem"), F.contains(first, F.lit("que")).alias("stem_has_figure"), F.contains(first, F.lit("die")).alias("is_multi"), F.when(F.contains(F.get("ls", F.lit(1)), F.lit("ung")), F.array(F.lit("p"))).otherwise(strings).alias("part_problems"), (n - F.length(F.replace(first, F.lit(","), F.lit("")))).alias("warns"),
                 F.when(n % 3 > 0, "choice").otherwise("text").alias("kind"), F.transform(opts, lambda o: F.when(F.length(o) % 5 == 0, "").otherwise(o)).alias("options"), F.transform(opts, lambda o, i: F.char(65 + i)).alias("labels"), (n % 4 == 0).alias("has_group"), F.when(F.contains("text", F.lit(" la ")), F.element_at("ls", -1)).alias("passage"), (n % 8 == 0).alias("instruction_only"),
                 F.when(k % 3 == 0, "choice").when(k % 3 == 1, "text").alias("answer_kind"), F.array(F.char(65 + (k % 5))).alias("answer_labels"), (k % 2 == 0).alias("letter_key"))
    return q.select("doc_id", F.array_join(K.derived_flags(q), ",").alias("flags"))


@query("""WITH w AS (SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('error', 'purchase') AND user_id % 7 = 3) SELECT *, (SELECT count(*) FROM w) AS total FROM w ORDER BY value DESC, event_id LIMIT 25 OFFSET 50""")
def r30_any_list(t):
    rows = t.events.select("event_id", "user_id", "event_type", "value", (c("user_id") % 7).alias("rest"))
    return K.filtered_list(rows, {"event_type": ("error", "purchase"), "rest": 3, "user_id": None}, [("value", True), ("event_id", False)], 3, 25).drop("rest")


_PERIODS = "SELECT o_custkey AS user_id, CASE WHEN o_orderstatus = 'P' THEN 'revoked' ELSE 'active' END AS status, o_orderdate AS starts_at, o_orderdate + INTERVAL 200 DAY AS expires_at FROM orders WHERE o_orderkey % 2 = 0"


def _plans(t, plan):
    now = F.lit("2001-06-30").cast("timestamp")
    at = c("o_orderdate").cast("timestamp")
    users = t.customer.select(c("c_custkey").alias("user_id"), F.when(c("c_custkey") % 50 == 0, "admin").otherwise("student").alias("role"))
    periods = t.orders.where("o_orderkey % 2 = 0").select(c("o_custkey").alias("user_id"), F.when(c("o_orderstatus") == "P", "revoked").otherwise("active").alias("status"), at.alias("starts_at"), (at + F.make_interval(days=F.lit(200))).alias("expires_at"))
    sessions = t.orders.where("o_orderkey % 2 = 1").select(c("o_custkey").alias("user_id"), F.when(c("o_orderstatus") == "F", "submitted").otherwise("open").alias("status"))
    return K.user_list(users, periods, sessions, now, plan)


_USERS = f"""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN 'ADMIN' WHEN (SELECT bool_or(starts_at <= TIMESTAMP '2001-06-30' AND expires_at > TIMESTAMP '2001-06-30') FROM ({_PERIODS}) p WHERE p.user_id = c_custkey AND status = 'active') THEN 'PRO' WHEN EXISTS (SELECT 1 FROM ({_PERIODS}) p WHERE p.user_id = c_custkey AND status = 'active') THEN 'EXPIRED' ELSE 'FREE' END AS plan,
(SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 1) AS sessions, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 2 = 1 AND o_orderstatus = 'F') AS submitted FROM customer"""


@query(_USERS)
def r14_users_by_plan(t):
    return _plans(t, None)


@query(f"SELECT * FROM ({_USERS}) WHERE plan = 'PRO'")
def r14_pro_users(t):
    return _plans(t, "PRO")


@query("""WITH q AS (SELECT lang AS subject, CASE WHEN n_chars % 5 <> 0 THEN source END AS topic FROM documents WHERE n_chars % 3 <> 0), s AS (SELECT DISTINCT lang AS subject FROM documents WHERE lang <> 'es' UNION ALL SELECT 'xx'), n AS (SELECT s.subject, count(q.subject) AS total FROM s LEFT JOIN q ON q.subject = s.subject GROUP BY 1)
SELECT subject, NULL::VARCHAR AS topic, total, least(total, 100) AS free, least(total, 100) AS available FROM n UNION ALL SELECT subject, topic, count(*), NULL, NULL FROM q WHERE topic IS NOT NULL AND (SELECT count(topic) >= 0.6 * count(*) FROM q) GROUP BY 1, 2""")
def r15_full_catalogue(t):
    q = t.documents.select(c("lang").alias("subject"), F.when(c("n_chars") % 5 != 0, c("source")).alias("topic"), (c("n_chars") % 3 != 0).alias("served"))
    subjects = t.documents.select(c("lang").alias("subject")).distinct().select("subject", (c("subject") != "es").alias("active")).union(t.region.limit(1).select(F.lit("xx"), F.lit(True)))
    return K.catalogue(q, subjects, 100, False, 0.6)
