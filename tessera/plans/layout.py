"""Boxes on pages, lines by gaps, regions between markers, grids of tables, on columns that vary row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import geometry as G
from tessera.operators import regions as R
from tessera.plans.base import query

c = F.col
#: Boxes of ``events`` (small) and ``part`` (up to 500 wide), on seven pages.
_GLYPHS = "SELECT event_id AS id, user_id % 7 AS page, floor(value * 3) AS x0, (event_id * 37 % 900)::DOUBLE AS y0, floor(value * 3) + 4 AS x1, (event_id * 37 % 900 + 6)::DOUBLE AS y1 FROM events"
_RULES = "SELECT p_partkey AS id, p_partkey % 7 AS page, (p_partkey * 53 % 1100)::DOUBLE AS x0, (p_partkey * 29 % 800)::DOUBLE AS y0, (p_partkey * 53 % 1100 + p_size * p_size // 5)::DOUBLE AS x1, (p_partkey * 29 % 800 + p_size * 4)::DOUBLE AS y1 FROM part"


def _glyphs(t):
    x, y = F.floor(c("value") * 3).cast("double"), (c("event_id") * 37 % 900).cast("double")
    return t.events.select(c("event_id").alias("id"), (c("user_id") % 7).alias("page"), x.alias("x0"), y.alias("y0"), (x + 4).alias("x1"), (y + 6).alias("y1"))


def _rules(t):
    x, y, size = (c("p_partkey") * 53 % 1100).cast("double"), (c("p_partkey") * 29 % 800).cast("double"), c("p_size").cast("long")
    return t.part.select(c("p_partkey").alias("id"), (c("p_partkey") % 7).alias("page"), x.alias("x0"), y.alias("y0"), (x + F.floor(size * size / 5)).alias("x1"), (y + size * 4).alias("y1"))


@query(f"""WITH g AS ({_GLYPHS}), r AS ({_RULES})
SELECT g.id, count(r.id) AS holders, arg_min(r.id, ((r.x1 - r.x0) * (r.y1 - r.y0), r.id)) AS innermost
FROM g LEFT JOIN r ON g.page = r.page AND g.x0 >= r.x0 - 1.5 AND g.x1 <= r.x1 + 1.5 AND g.y0 >= r.y0 - 1.5 AND g.y1 <= r.y1 + 1.5 GROUP BY g.id""")
def g5_innermost_box(t):
    return G.holders(_glyphs(t), _rules(t), 1.5).withColumnRenamed("outer_id", "innermost")


@query(f"""WITH r AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM ({_RULES}))
SELECT a.id, arg_min(b.id, (b.area, -b.id)) AS parent, count(b.id) AS depth FROM r a LEFT JOIN r b ON a.page = b.page AND a.id <> b.id
AND a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 AND (b.area > a.area OR b.id < a.id) GROUP BY a.id""")
def g5_nested_boxes(t):
    return G.nesting(_rules(t))


#: Boxes small and sparse enough to form many groups.
_FIGURES = "SELECT p_partkey AS id, p_partkey % 11 AS page, (p_partkey * 7919 % 1201)::DOUBLE AS x0, (p_partkey * 104729 % 907)::DOUBLE AS y0, (p_partkey * 7919 % 1201 + p_size)::DOUBLE AS x1, (p_partkey * 104729 % 907 + 51 - p_size)::DOUBLE AS y1 FROM part"


@query(f"""WITH RECURSIVE f AS MATERIALIZED ({_FIGURES}),
grown AS (SELECT 0 AS round, id, page, x0, y0, x1, y1 FROM f UNION ALL
  SELECT a.round + 1, a.id, a.page, min(b.x0), min(b.y0), max(b.x1), max(b.y1) FROM grown a JOIN grown b
    ON a.page = b.page AND a.x0 <= b.x1 + 5 AND b.x0 <= a.x1 + 5 AND a.y0 <= b.y1 + 5 AND b.y0 <= a.y1 + 5 WHERE a.round < 60 GROUP BY a.round, a.id, a.page)
SELECT min(id) AS id, page, x0, y0, x1, y1, count(*) AS n FROM grown WHERE round = 60 GROUP BY page, x0, y0, x1, y1""")
def g6_merged_boxes(t):
    x, y, size = (c("p_partkey") * 7919 % 1201).cast("double"), (c("p_partkey") * 104729 % 907).cast("double"), c("p_size")
    return G.merge_boxes(t.part.select(c("p_partkey").alias("id"), (c("p_partkey") % 11).alias("page"), x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + 51 - size).alias("y1")), 5.0)


@query("""WITH spots AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS pos, max(value) AS h, count(*) AS n FROM events GROUP BY 1, 2),
cut AS (SELECT *, coalesce(pos - lag(pos) OVER w > 400 * lag(h) OVER w, false) AS opens FROM spots WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
lines AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY pos)::BIGINT AS cluster FROM cut)
SELECT user_id, cluster, min(pos) AS first, max(pos) AS last, sum(n)::BIGINT AS n FROM lines GROUP BY 1, 2""")
def g3_gap_clusters(t):
    at = F.unix_micros(c("ts").cast("timestamp")) / 1000000.0
    return G.gap_clusters(t.events.select("user_id", at.alias("at"), "value"), "user_id", "at", "value", 400.0)


#: Lines of texts, five a page: a long first word is a label, a question mark or a long line stops a region.
_LINES = r"SELECT doc_id, i, i // 5 AS page, line, CASE WHEN regexp_matches(line, '^[A-Za-z]{9,}') THEN regexp_extract(line, '^[A-Za-z]+') END AS label, length(line) > 400 OR line LIKE '%from%' AS stops FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


def _lines(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    label = F.when(c("line").rlike("^[A-Za-z]{9,}"), F.regexp_extract("line", "^[A-Za-z]+", 0))
    return lines.select("doc_id", "i", F.floor(c("i") / 5).alias("page"), "line", label.alias("label"), ((F.length("line") > 400) | c("line").contains("from")).alias("stops"))


@query(f"""WITH l AS ({_LINES}), o AS (SELECT doc_id, i, label, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS region, lead(i, 1, 1000000000) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l WHERE label IS NOT NULL),
e AS (SELECT o.*, least(nxt - 1, coalesce((SELECT min(s.i) FROM l s WHERE s.doc_id = o.doc_id AND s.i >= o.i AND s.i < o.nxt AND s.stops), 1000000000)) AS z FROM o)
SELECT e.doc_id, region, any_value(e.label) AS name, min(page) AS first_page, max(page) AS last_page, count(*) AS lines, CASE WHEN max(page) - min(page) < 3 THEN string_agg(line, chr(10) ORDER BY l.i) END AS text
FROM e JOIN l ON l.doc_id = e.doc_id AND l.i BETWEEN e.i AND e.z GROUP BY e.doc_id, region""")
def g4_label_regions(t):
    return R.region_texts(_lines(t), "doc_id", ["i"], "label", "stops", "page", "line")


@query(f"""WITH p AS MATERIALIZED (SELECT doc_id, i, line, length(line) % 5 = 2 AS q, length(line) % 7 = 1 AS h, length(line) % 11 < 2 AS m, length(line) % 13 = 5 AS x, NOT regexp_matches(line, '[0-9]') AS plain, trim(line) = '' AS blank FROM ({_LINES})),
asked AS (SELECT q.doc_id, q.i, (SELECT max(h.i) FROM p h WHERE h.doc_id = q.doc_id AND h.h AND h.i < q.i AND h.i >= q.i - 600) AS h FROM p q WHERE q.q),
looked AS (SELECT a.*, (SELECT bool_or(m.m) FROM p m WHERE m.doc_id = a.doc_id AND m.i > a.h AND m.i < a.i) AS between_, (SELECT m.m FROM p m WHERE m.doc_id = a.doc_id AND m.i = a.h) AS own,
  (SELECT max(m.i) FROM p m WHERE m.doc_id = a.doc_id AND m.m AND m.i < a.h AND m.i >= a.h - 25) AS mark, (SELECT min(x.i) FROM p x WHERE x.doc_id = a.doc_id AND x.x AND x.i > a.h AND x.i < a.i) AS stop FROM asked a),
bounds AS (SELECT *, CASE WHEN own THEN h + 1 ELSE mark + 1 END AS a, CASE WHEN own THEN coalesce(stop, i) ELSE h END AS z FROM looked),
totals AS (SELECT b.doc_id, b.i, any_value(b.h) AS h, any_value(between_) AS between_, any_value(own) AS own, any_value(mark) AS mark, any_value(a) AS a, any_value(z) AS z, coalesce(bool_or(NOT p.plain), false) AS odd, coalesce(bool_or(p.x AND NOT p.blank), false) AS bad,
  coalesce(sum(length(p.line)) FILTER (NOT p.blank), 0) AS size, coalesce(string_agg(p.line, chr(10) ORDER BY p.i) FILTER (NOT p.blank), '') AS body FROM bounds b LEFT JOIN p ON p.doc_id = b.doc_id AND p.i >= b.a AND p.i < b.z GROUP BY b.doc_id, b.i),
judged AS (SELECT *, CASE WHEN h IS NULL THEN 'no_instruction' WHEN between_ THEN 'other_passage_between' WHEN NOT own AND mark IS NULL THEN 'no_marker' WHEN odd THEN 'not_plain' WHEN bad THEN 'question_lines' WHEN size < 300 THEN 'too_short' END AS reason FROM totals)
SELECT doc_id, i, reason, CASE WHEN reason IS NULL THEN a END AS first, CASE WHEN reason IS NULL THEN z END AS last, CASE WHEN reason IS NULL THEN body END AS passage FROM judged""")
def e11_recovered_passages(t):
    n = F.length("line")
    flags = {"q": n % 5 == 2, "h": n % 7 == 1, "m": n % 11 < 2, "x": n % 13 == 5, "plain": ~c("line").rlike("[0-9]")}
    return R.recover_passages(_lines(t).withColumns(flags), "doc_id", "i", "line", "q", "h", "m", "x", "plain")


#: Sources put together from a document and an item in six ways: whole, sentences turned round, torn apart, left out, twice, cut short.
_SOURCES = r"""SELECT doc_id, item_id, CASE doc_id % 6 WHEN 0 THEN [d1, b, d2] WHEN 1 THEN [d1, array_to_string(list_reverse(fs), ''), d2] WHEN 2 THEN [d1, array_to_string(fs[:2], ''), d2, array_to_string(fs[3:], '')] WHEN 3 THEN [d1, d2] WHEN 4 THEN [b, d1, b, d2] ELSE [d1, d2, substr(b, 1, 70)] END AS pages,
fs, CASE WHEN doc_id % 4 = 3 THEN list_reverse(ws[1:4]) ELSE ws[1:4] END AS options, substr(d1, 1, 100) AS passage
FROM (SELECT doc_id, item_id, key(substr(d.text, 1, 700)) AS d1, key(substr(d.text, 701)) AS d2, key(b.text) AS b, list_transform(regexp_split_to_array(b.text, '[.\n]+'), lambda x: key(x)) AS fs, list_transform(string_split(b.text, ' '), lambda x: key(x)) AS ws FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id % 40)"""


def _source_sql() -> str:
    import re

    return re.sub(r"\bkey\(((?:[^()]|\([^()]*\))*)\)", r"regexp_replace(lower(\1), '[^\\p{L}\\p{N}]+', '', 'g')", _SOURCES)


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, array_to_string(pages, '') AS src, array_to_string(fs, '') AS whole, list_filter(fs, lambda x: length(x) >= 4) AS ps FROM ({_source_sql()})),
f AS MATERIALIZED (SELECT *, CASE WHEN contains(src, substr(whole, 1, 60)) THEN substr(whole, 1, 60) ELSE substr(whole, 1, 40) END AS probe, instr(src, CASE WHEN contains(src, substr(whole, 1, 60)) THEN substr(whole, 1, 60) ELSE substr(whole, 1, 40) END) AS pos FROM s),
stems AS (SELECT doc_id, item_id, 0 AS n, pos AS spot, NULL::VARCHAR AS lost FROM f WHERE pos > 0 UNION ALL
  SELECT f.doc_id, f.item_id, n + 1, spot + k - 1, CASE WHEN k = 0 OR k - 1 > 3000 THEN ps[n + 1] END FROM (SELECT stems.*, instr(substr(src, spot), substr(ps[n + 1], 1, 80)) AS k FROM stems JOIN f USING (doc_id, item_id) WHERE lost IS NULL AND n < len(ps)) JOIN f USING (doc_id, item_id)),
picks AS (SELECT doc_id, item_id, 0 AS n, 1::BIGINT AS spot, NULL::VARCHAR AS lost FROM f WHERE pos > 0 UNION ALL
  SELECT f.doc_id, f.item_id, n + 1, CASE WHEN options[n + 1] <> '' AND k > 0 THEN spot + k ELSE spot END, CASE WHEN options[n + 1] <> '' AND k = 0 THEN concat_ws(',', lost, n + 1) ELSE lost END FROM (SELECT picks.*, instr(substr(src, pos + spot - 1, 6000 - spot + 1), options[n + 1]) AS k FROM picks JOIN f USING (doc_id, item_id) WHERE n < len(options)) JOIN f USING (doc_id, item_id)),
a AS (SELECT doc_id, item_id, max(lost) AS lost FROM stems GROUP BY ALL), b AS (SELECT doc_id, item_id, arg_max(lost, n) AS x, max_by(coalesce(lost, ''), n) AS lost FROM picks GROUP BY ALL),
j AS (SELECT f.*, a.lost AS piece, nullif(b.lost, '') AS picked, CASE WHEN length(whole) < 12 THEN 'stem_too_short' WHEN pos = 0 THEN 'stem_not_found' WHEN a.lost IS NOT NULL THEN 'stem_fragment' WHEN b.lost <> '' THEN 'options'
  WHEN length(substr(passage, 1, 60)) >= 20 AND NOT contains(substr(src, greatest(pos - 30000, 1), pos - greatest(pos - 30000, 1) + 1), substr(passage, 1, 60)) THEN 'passage' END AS reason FROM f LEFT JOIN a USING (doc_id, item_id) LEFT JOIN b USING (doc_id, item_id))
SELECT doc_id, item_id, reason, CASE reason WHEN 'stem_fragment' THEN piece WHEN 'options' THEN picked WHEN 'passage' THEN substr(passage, 1, 60) END AS failing,
CASE WHEN reason IS DISTINCT FROM 'stem_too_short' AND pos > 0 THEN len(list_filter(range(1, len(pages) + 1), lambda i: length(array_to_string(pages[:i], '')) < pos)) + 1 END AS page,
reason IS DISTINCT FROM 'stem_too_short' AND pos > 0 AND contains(substr(src, pos + 1), probe) AS twice FROM j""")
def e2_fragment_order(t):
    key = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")
    items = t.benchmark.select("item_id", key(c("text")).alias("b"), F.transform(F.split("text", r"[.\n]+", -1), key).alias("fs"), F.transform(F.split("text", " ", -1), key).alias("ws"))
    docs = t.documents.select("doc_id", key(F.substring("text", 1, 700)).alias("d1"), key(F.substring(c("text"), F.lit(701), F.length("text"))).alias("d2"))
    both = docs.join(items, c("doc_id") % 40 == c("item_id") % 40)
    turned, way = F.array_join(F.reverse("fs"), ""), c("doc_id") % 6
    torn = F.array("d1", F.array_join(F.slice("fs", 1, 2), ""), "d2", F.array_join(F.slice(c("fs"), F.lit(3), F.size("fs")), ""))
    pages = F.when(way == 0, F.array("d1", "b", "d2")).when(way == 1, F.array(c("d1"), turned, c("d2"))).when(way == 2, torn).when(way == 3, F.array("d1", "d2")).when(way == 4, F.array("b", "d1", "b", "d2")).otherwise(F.array(c("d1"), c("d2"), F.substring("b", 1, 70)))
    options = F.slice("ws", 1, 4)
    asked = both.select("doc_id", "item_id", pages.alias("pages"), "fs", F.when(c("doc_id") % 4 == 3, F.reverse(options)).otherwise(options).alias("options"), F.substring("d1", 1, 100).alias("passage"))
    return R.verify_fragments(asked, "pages", "fs", "options", "passage").select("doc_id", "item_id", "reason", "failing", "page", "twice")
