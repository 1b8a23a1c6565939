"""Scalar functions over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.cdc import hash_key
from tessera.plans.base import query

c = F.col


@query(r"SELECT doc_id, rtrim(regexp_replace(translate(lower(regexp_replace(nfc_normalize(text), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '−–', '--'), '[\s\p{Z}]+', ' ', 'g'), '.') AS t FROM documents")
def c1_norm_text(t):
    return t.documents.select("doc_id", T.norm_text(c("text")).alias("t"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_orderkey % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity / l_linenumber WHEN 2 THEN l_quantity * 1000 ELSE NULL END AS value FROM lineitem""")
def c2_parse_number(t):
    q = F.regexp_replace(c("l_quantity").cast("string"), r"\.0$", "")
    raw = F.when(c("l_orderkey") % 4 == 0, F.concat(q, F.lit(",0"))).when(c("l_orderkey") % 4 == 1, F.concat(q, F.lit(" / "), c("l_linenumber").cast("string"))).when(c("l_orderkey") % 4 == 2, F.concat(q, F.lit(".000"))).otherwise("n/a")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.parse_number(raw).alias("value"))


@query(r"SELECT doc_id, regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}]+', '', 'g') AS key FROM documents")
def c3_norm_key(t):
    return t.documents.select("doc_id", T.norm_key(c("text")).alias("key"))


@query(r"SELECT doc_id, regexp_replace(strip_accents(lower(replace(replace(text, 'đ', 'd'), 'Đ', 'd'))), '[^0-9a-z]', '', 'g') AS key FROM documents")
def c4_fold_accents(t):
    return t.documents.select("doc_id", T.fold_accents("text").alias("key"))


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: NOT regexp_matches(w, '^[0-9]$'))) AS n FROM documents")
def c5_words(t):
    return t.documents.select("doc_id", F.size(T.words(c("text"))).cast("long").alias("n"))


@query("SELECT d.doc_id, sha256(d.doc_id::VARCHAR || chr(31) || coalesce(quality::VARCHAR, 'None') || chr(31) || source) AS h FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def c6_hash_key(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", hash_key("doc_id", "quality", "source").alias("h"))


@query(r"""SELECT conv_id, turn, sha256('{"role":"' || role || '","text":"' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"}') AS h FROM conversations""")
def c7_content_hash(t):
    return t.conversations.select("conv_id", "turn", F.sha2(F.to_json(F.struct("role", "text")), 256).alias("h"))


@query("SELECT doc_id, substr(trim(regexp_replace(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D')), '[^A-Za-z0-9]+', ' ', 'g')), 1, 50) AS a FROM documents")
def c8_ascii_content(t):
    return t.documents.select("doc_id", T.ascii_content(c("text")).alias("a"))


def _crc_sql(text: str) -> str:
    """CRC-16/CCITT in SQL: the register is folded over the bytes, eight shifts each."""
    shift = "CASE WHEN {0} & 32768 <> 0 THEN xor({0} << 1, 4129) & 65535 ELSE ({0} << 1) & 65535 END"
    step = f"list_reduce(list_prepend(xor(acc, b << 8), [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, _: {shift.format('r')})"
    return f"list_reduce(list_prepend(65535, list_transform(string_split({text}, ''), lambda ch: ord(ch))), lambda acc, b: {step})"


_TLV = "CASE WHEN length({1}) <= 99 THEN '{0}' || lpad(length({1})::VARCHAR, 2, '0') || {1} END"


@query(f"""SELECT o_orderkey, body || upper(lpad(to_hex({_crc_sql('body')}), 4, '0')) AS payload
FROM (SELECT o_orderkey, {_TLV.format('00', "'01'")} || {_TLV.format('54', 'o_orderkey::VARCHAR')} || coalesce({_TLV.format('62', "repeat('x', (o_orderkey % 200)::INT)")}, '') || '6304' AS body FROM orders)""")
def c9_tlv_crc(t):
    note = F.coalesce(T.tlv("62", F.expr("repeat('x', cast(o_orderkey % 200 AS int))")), F.lit(""))
    body = F.concat(T.tlv("00", F.lit("01")), T.tlv("54", c("o_orderkey").cast("string")), note, F.lit("6304"))
    return t.orders.select("o_orderkey", T.with_crc16(body).alias("payload"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'REF' || lpad(o_orderkey::VARCHAR, 8, '0') END AS code FROM orders")
def c10_find_code(t):
    text = F.concat(F.lit("pay. ref "), F.when(c("o_orderkey") % 3 == 0, F.lit("-")).otherwise(F.lpad(c("o_orderkey").cast("string"), 8, "0")), F.lit(" thanks!"))
    return t.orders.select("o_orderkey", T.find_code(text, "REF", "0-9").alias("code"))


@query(r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '(?:^|\n)\s*\**([a-h])\)', 1)))::INT AS n FROM documents")
def c12_statement_count(t):
    return t.documents.select("doc_id", T.statement_count(F.lower("text")).alias("n"))


@query(r"SELECT user_id, string_agg(DISTINCT (event_id % 5)::VARCHAR, ',' ORDER BY (event_id % 5)::VARCHAR) AS pages FROM events GROUP BY user_id")
def c14_pages_of(t):
    block = F.concat(F.lit("p"), (c("event_id") % 5).cast("string"), F.lit("-b"), c("event_id").cast("string"))
    page = lambda b: F.regexp_extract(b, r"^p(\d+)-", 1)
    g = t.events.groupBy("user_id").agg(F.collect_list(block).alias("bs"))
    return g.select("user_id", F.array_join(F.array_sort(F.array_distinct(F.transform("bs", page))), ",").alias("pages"))


@query("SELECT event_id, date_trunc('minute', ts) - INTERVAL 7 HOUR AS utc FROM events")
def c16_lenient_time(t):
    return t.events.select("event_id", T.lenient_time(F.date_format("ts", "dd/MM/yyyy HH:mm")).alias("utc"))


@query("SELECT event_id, floor(epoch(ts) / 900)::BIGINT * 900 AS w FROM events")
def c17_window_floor(t):
    s = F.floor(F.unix_micros(c("ts").cast("timestamp")) / 1_000_000)
    return t.events.select("event_id", (s - F.pmod(s, F.lit(900))).alias("w"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS due, date_diff('day', o_orderdate::DATE, DATE '2001-12-31') AS days FROM orders")
def c18_date_arithmetic(t):
    return t.orders.select("o_orderkey", (c("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("due"), F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("o_orderdate")).cast("long").alias("days"))


@query(r"SELECT doc_id, contains(text, chr(65533)) AS replaced, round(length(regexp_replace(text, '[\p{L}\p{N}\s.,;:!?()\[\]{}\-–—''\x22“”‘’/%+=<>*…°]', '', 'g')) / length(text)::DOUBLE, 4) AS odd FROM documents WHERE length(text) >= 40")
def c22_ocr_suspect(t):
    return t.documents.where(F.length("text") >= 40).select("doc_id", c("text").contains("�").alias("replaced"), F.round(T.odd_share(c("text")), 4).alias("odd"))


LEXICONS = {"english": ["the", "and", "with"], "german": ["die", "und", "mit"], "french": ["les", "dans", "avec"]}


@query(r"SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'and', 'with'))) // 2 AS english, len(list_filter(w, lambda x: x IN ('die', 'und', 'mit'))) AS german, len(list_filter(w, lambda x: x IN ('les', 'dans', 'avec'))) AS french FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}]+') AS w FROM documents)")
def c24_lexicon_scores(t):
    m = T.lexicon_counts(c("text"), LEXICONS, halved=("english",))
    return t.documents.select("doc_id", *[m[k].cast("long").alias(k) for k in LEXICONS])


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') AND NOT contains(lower(text), 'copyright') THEN 'license' WHEN contains(lower(text), 'copyright') AND NOT contains(lower(text), 'license') THEN 'copyright' END AS subject FROM documents")
def c25_heading_subject(t):
    hits = F.filter(F.array(F.lit("license"), F.lit("copyright")), lambda k: F.contains(F.lower("text"), k))
    return t.documents.select("doc_id", F.when(F.size(hits) == 1, hits[0]).alias("subject"))


@query("""WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS ev FROM events GROUP BY user_id)
SELECT user_id, array_to_string(ev, ',') AS all_types, array_to_string(list_sort(list_filter(ev, lambda x: x <> 'click')), ',') AS rest, array_to_string(list_sort(list_distinct(list_concat(ev, ['extra']))), ',') AS more FROM a""")
def c28_array_functions(t):
    a = t.events.groupBy("user_id").agg(F.array_sort(F.array_distinct(F.collect_list("event_type"))).alias("ev"))
    return a.select("user_id", F.array_join("ev", ",").alias("all_types"), F.array_join(F.array_sort(F.array_except("ev", F.array(F.lit("click")))), ",").alias("rest"), F.array_join(F.array_sort(F.array_union("ev", F.array(F.lit("extra")))), ",").alias("more"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, format('{:.6f}', l_extendedprice * (1 - l_discount))::DOUBLE AS net, format('{:.2f}', l_linenumber + 0.675)::DOUBLE AS near_tie, format('{:.2f}', l_quantity / 8)::DOUBLE AS tie FROM lineitem")
def c29_rounding(t):
    exact = {"net": (c("l_extendedprice") * (1 - c("l_discount")), 6), "near_tie": (c("l_linenumber") + 0.675, 2), "tie": (c("l_quantity") / 8, 2)}
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[T.round_even(x, n).alias(k) for k, (x, n) in exact.items()])
