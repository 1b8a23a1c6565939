"""Sampling, scoring and sessions on orders and line items: N is correct, R incorrect, A unanswered."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import scoring as S
from tessera.operators.filters import all_of, between, equals
from tessera.operators.windows import greedy_fill
from tessera.plans.base import query

c = F.col
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEYS = _KEYS.split(", ")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars BETWEEN 300 AND 2000")
def d1_pool(t):
    return t.documents.where(all_of(equals("lang", "en"), between("n_chars", 300, 2000), equals("source", None))).select("doc_id")


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'g:' || o_custkey ELSE 'q:' || o_orderkey END AS unit, count(*) AS size FROM orders GROUP BY 1")
def d2_units(t):
    unit = F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("g:"), c("o_custkey").cast("string"))).otherwise(F.concat(F.lit("q:"), c("o_orderkey").cast("string")))
    return t.orders.groupBy(unit.alias("unit")).agg(F.count("*").alias("size"))


@query("""WITH RECURSIVE u AS (SELECT p_type AS pool, p_partkey AS unit, (p_size % 5 + 1)::BIGINT AS size, row_number() OVER (PARTITION BY p_type ORDER BY sha256('seed' || chr(31) || p_partkey), p_partkey) AS r FROM part WHERE p_size % 5 + 1 <= 4),
f AS (SELECT pool, unit, r, size AS used, true AS taken FROM u WHERE r = 1 UNION ALL SELECT u.pool, u.unit, u.r, CASE WHEN f.used + u.size <= 30 THEN f.used + u.size ELSE f.used END, f.used + u.size <= 30 FROM f JOIN u ON u.pool = f.pool AND u.r = f.r + 1)
SELECT pool, unit FROM f WHERE taken""")
def d3_hash_order_quota(t):
    u = t.part.select(c("p_type").alias("pool"), c("p_partkey").alias("unit"), (c("p_size") % 5 + 1).alias("size"), F.sha2(F.concat_ws("\u001f", F.lit("seed"), c("p_partkey").cast("string")), 256).alias("h"))
    return greedy_fill(u.where("size <= 4"), ["pool"], "unit", "size", ["h", "unit"], 30).select("pool", "unit")


@query("""WITH a AS (SELECT p_partkey, 1 AS pool FROM part WHERE p_size < 20 ORDER BY sha256('a' || p_partkey), p_partkey LIMIT 50),
b AS (SELECT p_partkey, 2 AS pool FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT p_partkey FROM a) ORDER BY sha256('b' || p_partkey), p_partkey LIMIT 50) SELECT * FROM a UNION ALL SELECT * FROM b""")
def d4_cross_pool_exclusion(t):
    take = lambda df, seed, n: df.orderBy(F.sha2(F.concat(F.lit(seed), c("p_partkey").cast("string")), 256), "p_partkey").limit(50).select("p_partkey", F.lit(n).alias("pool"))
    a = take(t.part.where("p_size < 20"), "a", 1)
    return a.union(take(t.part.where("p_size > 10").join(a, "p_partkey", "left_anti"), "b", 2))


@query("SELECT p_brand, count(*) AS available, 100 AS wanted, greatest(100 - count(*), 0) AS missing FROM part GROUP BY p_brand")
def d5_shortage(t):
    g = t.part.groupBy("p_brand").agg(F.count("*").alias("available"))
    return g.select("p_brand", "available", F.lit(100).alias("wanted"), F.greatest(100 - c("available"), F.lit(0)).alias("missing"))


@query("SELECT p_partkey, i AS position FROM (SELECT unnest([42, 7, 99]) AS k, generate_subscripts([42, 7, 99], 1) AS i) JOIN part ON p_partkey = k")
def d6_fixed_items(t):
    fixed = t.spark.range(1).select(F.posexplode(F.array(*map(F.lit, (42, 7, 99)))).alias("i", "k"))
    return t.part.join(F.broadcast(fixed), c("p_partkey") == c("k")).select("p_partkey", (c("i") + 1).alias("position"))


@query("SELECT p_type AS pool, sha256(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey)) AS fingerprint FROM part GROUP BY p_type")
def d7_fingerprint(t):
    return S.fingerprint(t.part.withColumnRenamed("p_type", "pool"), "pool", "p_partkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('s1' || chr(31) || o_orderkey), o_orderkey) AS place FROM orders")
def d8_section_shuffle(t):
    h = F.sha2(F.concat_ws("\u001f", F.lit("s1"), c("o_orderkey").cast("string")), 256)
    return t.orders.withColumn("h", h).select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("h", "o_orderkey")).alias("place"))


@query("SELECT o_orderkey, string_agg(x, '' ORDER BY sha256(o_orderkey || chr(31) || x)) AS options FROM (SELECT o_orderkey, unnest(['A', 'B', 'C', 'D']) AS x FROM orders) GROUP BY o_orderkey")
def d9_option_permutation(t):
    return t.orders.select("o_orderkey", F.array_join(S.shuffled(F.array(*map(F.lit, "ABCD")), c("o_orderkey")), "").alias("options"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('free|' || source || '|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10""")
def d10_free_pool(t):
    h = F.sha2(F.concat_ws("|", F.lit("free"), "source", c("doc_id").cast("string")), 256)
    u = t.documents.select("source", "doc_id", F.lit(1).alias("size"), h.alias("h"))
    return greedy_fill(u, ["source"], "doc_id", "size", ["h", "doc_id"], 10).select("source", "doc_id")


@query("SELECT p_type, count(*) AS available, count(*) >= 300 AS enough FROM part WHERE p_size > 10 GROUP BY p_type")
def d11_availability(t):
    return t.part.where("p_size > 10").groupBy("p_type").agg(F.count("*").alias("available")).withColumn("enough", c("available") >= 300)


@query("SELECT conv_id, turn, trim(coalesce(CASE WHEN turn % 2 = 0 THEN text ELSE '  ' END, '')) = '' AS blank FROM conversations")
def d12_blank(t):
    return t.conversations.select("conv_id", "turn", S.is_blank(text=F.when(c("turn") % 2 == 0, c("text")).otherwise("  ")).alias("blank"))


def scored(t):
    fraction = F.when(c("l_returnflag") == "N", F.when(c("l_linenumber") == 3, 0.5).otherwise(1.0)).otherwise(0.0)
    s = S.score(c("l_returnflag") == "A", c("l_linestatus") == "O", fraction, c("l_quantity"), incorrect=-0.25)
    return t.lineitem.select(*KEYS, s.alias("s")).select(*KEYS, "s.*")


_SCORED = f"""SELECT {_KEYS}, CASE WHEN l_returnflag = 'A' THEN 'unanswered' WHEN l_linestatus <> 'O' THEN 'ungraded' WHEN l_returnflag = 'R' THEN 'incorrect' WHEN l_linenumber = 3 THEN 'partial' ELSE 'correct' END AS outcome,
CASE WHEN l_linestatus <> 'O' OR l_returnflag = 'A' THEN 0.0 WHEN l_returnflag = 'R' THEN -0.25 * l_quantity WHEN l_linenumber = 3 THEN 0.5 * l_quantity ELSE l_quantity END::DOUBLE AS points, CASE WHEN l_linestatus <> 'O' THEN 0.0 ELSE l_quantity END::DOUBLE AS max_points FROM lineitem"""


@query(_SCORED)
def d13_score_item(t):
    return scored(t)


@query(f"""SELECT {_KEYS}, CASE WHEN l_quantity % 4 = 0 THEN 1.0 WHEN l_quantity % 4 = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS choice, CASE WHEN abs(l_quantity - 25) <= 0.1 * 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS numeric FROM lineitem""")
def d14_fractions(t):
    got = F.when(c("l_quantity") % 4 == 0, F.array(F.lit("A"), F.lit("C"))).when(c("l_quantity") % 4 == 1, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    return t.lineitem.select(*KEYS, S.choice_fraction(F.array(F.lit("A"), F.lit("C")), got, partial=True).alias("choice"), S.numeric_fraction(F.lit(25.0), c("l_quantity"), 0.1).alias("numeric"))


@query(f"SELECT {_KEYS}, [0.0, 0.1, 0.25, 0.5, 1.0][(l_linenumber % 5 + 1)::INT]::DOUBLE AS credit FROM lineitem")
def d15_step_table(t):
    want = F.array(*[F.lit(True)] * 4)
    got = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= c("l_linenumber") % 5)
    return t.lineitem.select(*KEYS, S.statements_fraction(want, got, "steps").alias("credit"))


@query(f"WITH s AS ({_SCORED}) SELECT l_orderkey, round(sum(points), 4) AS points, sum(max_points) AS max_points, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'partial') AS partial, count(*) FILTER (WHERE outcome = 'incorrect') AS incorrect, count(*) FILTER (WHERE outcome = 'unanswered') AS unanswered, count(*) FILTER (WHERE outcome = 'ungraded') AS ungraded FROM s GROUP BY l_orderkey")
def d16_session_rollup(t):
    return S.session_totals(scored(t), "l_orderkey").withColumn("points", F.round("points", 4))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'N' THEN l_linenumber END) / sum(CASE WHEN l_returnflag <> 'A' THEN l_linenumber END)::DOUBLE, 6) AS share FROM lineitem GROUP BY l_orderkey")
def d17_weighted_parts(t):
    w = lambda p: F.sum(F.when(p, c("l_linenumber")))
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.try_divide(w(c("l_returnflag") == "N"), w(c("l_returnflag") != "A")), 6).alias("share"))


@query("SELECT event_id, ts <= TIMESTAMP '2024-01-15' + INTERVAL 20 SECOND AS in_time FROM events")
def d19_deadlines(t):
    return t.events.select("event_id", (c("ts") <= F.lit("2024-01-15").cast("timestamp") + F.expr("INTERVAL 20 SECOND")).alias("in_time"))


@query("SELECT user_id, event_type, arg_max(props, event_id) AS props, least(sum(greatest(event_id % 100 - 10, 0)), 36000)::BIGINT AS seconds FROM events GROUP BY user_id, event_type")
def d20_autosave(t):
    e = t.events.withColumn("seconds", c("event_id") % 100 - 10)
    return S.autosave(e, ["user_id", "event_type"], ["event_id"], "props", "seconds")


@query("SELECT o_orderkey, chr(64 + list_position(list_transform(list_sort(list_transform(['A', 'B', 'C', 'D'], lambda x: sha256(o_orderkey || chr(31) || x) || x)), lambda y: right(y, 1)), 'C')::INT) AS letter FROM orders")
def d21_displayed_letter(t):
    place = F.array_position(S.shuffled(F.array(*map(F.lit, "ABCD")), c("o_orderkey")), "C")
    return t.orders.select("o_orderkey", F.chr(place + 64).alias("letter"))
