"""Change-data capture, versions and windowed counters on event data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cdc
from tessera.plans.base import query

c = F.col
_STATE = "SELECT doc_id, sha256(source) AS hash, doc_id % 10 = 0 AS removed FROM documents WHERE doc_id % 3 <> 0"
_SNAP = "SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END) AS hash FROM documents WHERE doc_id % 5 <> 0"


def _state(t):
    return t.documents.where("doc_id % 3 <> 0").select("doc_id", F.sha2("source", 256).alias("hash"), (c("doc_id") % 10 == 0).alias("removed"))


def _snap(t):
    return t.documents.where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(c("doc_id") % 4 == 0, c("lang")).otherwise(c("source")), 256).alias("hash"))


@query("SELECT o_orderkey, sha256(o_orderstatus || chr(31) || c_mktsegment || chr(31) || coalesce(n_name, 'None')) AS h FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 10")
def m1_source_hash(t):
    j = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation.where("n_nationkey < 10"), c("c_nationkey") == c("n_nationkey"), "left")
    return j.select("o_orderkey", cdc.hash_key("o_orderstatus", "c_mktsegment", "n_name").alias("h"))


@query(f"""WITH s AS ({_STATE}), n AS ({_SNAP}) SELECT * FROM (SELECT coalesce(s.doc_id, n.doc_id) AS doc_id,
CASE WHEN s.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN CASE WHEN NOT removed THEN 'removed' END WHEN removed THEN 'restored' WHEN s.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS change
FROM s FULL JOIN n ON s.doc_id = n.doc_id) WHERE change IS NOT NULL""")
def m2_snapshot_diff(t):
    return cdc.snapshot_diff(_state(t), _snap(t), "doc_id")


@query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 9 FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def m3_insert_if_absent(t):
    return cdc.upsert(t.labels.select("doc_id", "quality"), t.documents.where("lang = 'de'").select("doc_id", F.lit(9).alias("quality")), ["doc_id"], overwrite=False)


@query(f"""WITH v AS (SELECT doc_id, hash, 1 AS version_no FROM ({_STATE})), n AS ({_SNAP})
SELECT n.doc_id, CASE WHEN v.hash = n.hash THEN 1 ELSE coalesce(v.version_no, 0) + 1 END AS version_no FROM n LEFT JOIN v ON v.doc_id = n.doc_id""")
def m4_version_pointer(t):
    return cdc.append_versions(_state(t).select("doc_id", "hash", F.lit(1).alias("version_no")), _snap(t), "doc_id")[1]


@query(f"WITH s AS ({_STATE}), n AS ({_SNAP}) SELECT s.doc_id, CASE WHEN s.doc_id % 7 = 0 THEN s.hash ELSE n.hash END AS pointer, s.doc_id % 7 = 0 AND s.hash <> n.hash AS upstream_changed FROM s JOIN n ON s.doc_id = n.doc_id")
def m5_published_kept(t):
    j = _state(t).select("doc_id", c("hash").alias("h0")).join(_snap(t), "doc_id")
    mine = c("doc_id") % 7 == 0
    return j.select("doc_id", F.when(mine, c("h0")).otherwise(c("hash")).alias("pointer"), (mine & (c("h0") != c("hash"))).alias("upstream_changed"))


@query(f"WITH n AS ({_SNAP}) SELECT doc_id, removed OR doc_id NOT IN (SELECT doc_id FROM n) AS removed FROM ({_STATE})")
def m6_soft_delete(t):
    seen = _snap(t).select("doc_id", F.lit(True).alias("seen"))
    return _state(t).join(seen, "doc_id", "left").select("doc_id", (c("removed") | c("seen").isNull()).alias("removed"))


@query(f"WITH s AS ({_STATE}), n AS ({_SNAP}) SELECT n.doc_id, n.hash FROM n JOIN s ON s.doc_id = n.doc_id WHERE n.hash IS DISTINCT FROM s.hash")
def m8_write_changed_only(t):
    return _snap(t).join(_state(t).select("doc_id", c("hash").alias("h0")), "doc_id").where(~c("hash").eqNullSafe(c("h0"))).select("doc_id", "hash")


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders)
SELECT b.o_orderkey, 'status' AS field, b.status AS old, a.status AS new FROM b JOIN a USING (o_orderkey) WHERE a.status IS DISTINCT FROM b.status
UNION ALL SELECT b.o_orderkey, 'priority', b.priority, a.priority FROM b JOIN a USING (o_orderkey) WHERE a.priority IS DISTINCT FROM b.priority""")
def m9_field_changes(t):
    b = t.orders.select("o_orderkey", c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority"))
    a = b.select("o_orderkey", F.when(c("o_orderkey") % 5 == 0, "X").otherwise(c("status")).alias("status"), F.when(c("o_orderkey") % 7 != 0, c("priority")).alias("priority"))
    return cdc.field_changes(b, a, "o_orderkey", ["status", "priority"])


@query(f"WITH s AS ({_STATE}), n AS ({_SNAP}) SELECT count(*) FILTER (WHERE s.hash <> n.hash) AS drifted, count(*) AS checked FROM s JOIN n ON s.doc_id = n.doc_id")
def m10_content_drift(t):
    j = _state(t).select("doc_id", c("hash").alias("h0")).join(_snap(t), "doc_id")
    return j.agg(F.count_if(c("h0") != c("hash")).alias("drifted"), F.count("*").alias("checked"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'withheld' END, d.source) AS source, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def m11_overlay_precedence(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(F.when(c("toxic") == 1, "withheld"), "source").alias("source"), F.coalesce("quality", F.lit(0)).alias("quality"))


@query("SELECT doc_id, sha256(sha256(text) || chr(31) || sha256(lang)) AS semantic FROM documents")
def m12_part_hashes(t):
    return t.documents.select("doc_id", cdc.hash_key(F.sha2("text", 256), F.sha2("lang", 256)).alias("semantic"))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, count(*) > 5 AS rejected FROM events GROUP BY 1, 2")
def t1_window_counter(t):
    from tessera.streaming.windows import windowed_counts

    return windowed_counts(t.events, "user_id", "ts", "1 day", 5)


@query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def t3_idempotent_ingest(t):
    first = t.events.groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    return first.select("x.event_id", "user_id", "x.value")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'ignored' WHEN o_orderkey % 7 = 0 THEN 'unmatched' WHEN o_orderstatus = 'F' OR o_orderkey % 13 = 0 THEN 'late' WHEN o_orderkey % 3 = 0 THEN 'underpaid' ELSE 'matched' END AS status,
o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 3 <> 0 AND o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1998-01-01' AS after_expiry FROM orders""")
def t4_late_payments(t):
    from tessera.operators.ledger import match_status

    own = F.when(c("o_orderkey") % 13 == 0, "cancelled").when(c("o_orderstatus") == "F", "paid").when(c("o_orderdate") < F.lit("1998-01-01"), "expired").otherwise("pending")
    order = F.when(c("o_orderkey") % 7 != 0, own)
    received = c("o_totalprice") * F.when(c("o_orderkey") % 3 == 0, 0.5).otherwise(1.0)
    status = match_status(order, received, c("o_totalprice"), c("o_orderkey") % 11 != 0)
    return t.orders.select("o_orderkey", status.alias("status"), F.coalesce((status == "matched") & (order == "expired"), F.lit(False)).alias("after_expiry"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate + INTERVAL 90 DAY <= TIMESTAMP '1998-01-01' THEN 'expired' ELSE o_orderstatus END AS status FROM orders")
def t5_timeouts(t):
    due = c("o_orderdate") + F.expr("INTERVAL 90 DAY") <= F.lit("1998-01-01").cast("timestamp")
    return t.orders.select("o_orderkey", F.when((c("o_orderstatus") == "O") & due, "expired").otherwise(c("o_orderstatus")).alias("status"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT user_id, 0::BIGINT AS r, 'new' AS state FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, CASE WHEN f.state = 'new' AND e.event_type = 'signup' THEN 'member' WHEN f.state = 'member' AND e.event_type = 'purchase' THEN 'buyer' WHEN e.event_type = 'error' AND f.state = 'buyer' THEN 'returned' ELSE f.state END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, arg_max(state, r) AS state FROM f GROUP BY user_id""")
def t6_state_machine(t):
    from tessera.operators.ledger import fold_states

    return fold_states(t.events, "user_id", ["ts", "event_id"], "event_type", "new", {("new", "signup"): "member", ("member", "purchase"): "buyer", ("buyer", "error"): "returned"})


@query("""SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS n, count(*) > 1 AS rejected FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 1 DAY > (SELECT max(ts) FROM events)""")
def t2_live_windows(t):
    from tessera.streaming.expiry import live_counters

    return live_counters(t.events, "user_id", "ts", 21600, 1)


@query("""WITH d AS (SELECT event_id, user_id, value, least(datediff('day', DATE '2024-01-01', ts::DATE) // 6, 4) AS day FROM events), last AS (SELECT user_id, max(day) AS epoch FROM d WHERE event_id % 37 = 0 GROUP BY 1)
SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM d JOIN last USING (user_id) WHERE day <= epoch AND user_id % 5 <> epoch GROUP BY 1""")
def t7_refreshed_keys(t):
    """Five epochs of users with marked events, two epochs tried twice; in each a fifth of the users have no rows left."""
    from tessera.sources.scratch import shared_folder
    from tessera.streaming.refresh import current, write_epoch

    target = _own_folder(t.spark, shared_folder(t.spark))
    days = t.events.withColumn("day", F.least(F.floor(F.datediff(c("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 6), F.lit(4)))
    for epoch in (0, 1, 1, 2, 3, 3, 4):
        totals = lambda dirty, e=epoch: days.where(c("day") <= e).join(dirty, "user_id", "left_semi").where(c("user_id") % 5 != e).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        write_epoch(days.where((c("day") == epoch) & (c("event_id") % 37 == 0)), epoch, ["user_id"], totals, target, snapshot_every=3)
    return current(t.spark, target, ["user_id"]).select("user_id", "n", "total")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def m7_batched_import(t):
    """An import in four batches that breaks off after two and is started again."""
    from tessera.sources.batches import committed, import_batches
    from tessera.sources.scratch import shared_folder

    target = _own_folder(t.spark, shared_folder(t.spark))
    rows = t.orders.count() // 4 + 1
    for most in (2, None):
        import_batches(t.orders, target, "o_orderkey", "orders", rows, lambda df: df.select("o_orderkey", "o_custkey", "o_totalprice"), most)
    return committed(t.spark, target, "orders").drop("batch")


def _own_folder(spark, folder):
    import uuid

    from tessera.sources import scratch

    path = f"{folder}/tessera-{uuid.uuid4().hex}"
    scratch._kept.append(path)
    return path
