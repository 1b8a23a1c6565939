"""The thin queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chatformat, decontaminate, embdedup, htmltext, langid, lexsearch, linededup, minhash, packing, resample, secretscan, suffixdedup, tokencounts
from tessera.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs.where(~langid.held_out("doc_id")))
    return langid.predict_language(docs, profiles, carry=("doc_id",)).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_bytes(table(spark, sf_dir, "documents")).drop("starts", "stops")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = htmltext.extract_text(pages, htmltext.learn_weights(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    out = docs.select("doc_id").join(leaks, "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))


PROBE = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.sql(PROBE))
    chats = chatformat.format_chats(turns)
    back, loss = chatformat.read_turns(F.col("formatted")), chatformat.read_loss(F.col("segments"))
    chats = chats.select("conv_id", back.alias("back"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    listed = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = lexsearch.corpus_size(docs)
    return lexsearch.search(lexsearch.build_index(docs, size), table(spark, sf_dir, "benchmark"), size)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secretscan.scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secretscan.listed(F.col("base")), 256).alias("base_sha256"), secretscan.listed(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_minhash_dedup, op4_best_fit_packing, op5_line_dedup, op6_token_counts, op7_embedding_dedup, op8_html_text, op9_decontamination, op10_chat_format, op11_importance_resampling, op12_lexical_search, op13_secret_scan)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _secret_sql() -> str:
    quoted = [p.replace("'", "''") for p in secretscan.PATTERNS]
    good = {secretscan.ASSIGN: f"length(regexp_extract(m, '{quoted[0]}', 2)) >= {secretscan.SHORTEST}", secretscan.KEY: "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"}
    kinds = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, i, m, ends - length(m) AS s, ends AS e, {good.get(k, 'true')} AS good FROM (SELECT r, i, m, sum(gap + length(m)) OVER (PARTITION BY r ORDER BY i) AS ends FROM "
        f"(SELECT r, unnest(list_transform(pieces[:-2], lambda x: length(x))) AS gap, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM (SELECT r, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS ms FROM docs WHERE regexp_matches(text, '{p}'))))"
        for k, p in enumerate(quoted)
    )
    name = f"[{', '.join(repr(k) for k in secretscan.KINDS)}][kind + 1] || ':' || s || ':' || e"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS MATERIALIZED (SELECT r, kind, s::BIGINT AS s, e::BIGINT AS e FROM ({kinds}) WHERE good),
pairs AS (SELECT a.r, a.kind AS ak, a.s AS a0, a.e AS a1, p.kind, p.s, p.e FROM found a JOIN found p ON a.r = p.r AND a.kind IN (1, 3) AND p.kind IN (0, 2, 4, 5) AND p.s >= a.s - 300 AND p.e <= a.e + 300 AND (p.e <= a.s OR p.s >= a.e)
  WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.r = a.r AND b.kind = 6 AND b.s >= least(a.s, p.s) AND b.s < greatest(a.s, p.s))
    AND (p.kind <> 4 OR NOT EXISTS (SELECT 1 FROM found x WHERE x.r = p.r AND x.kind NOT IN (4, 6) AND x.s < p.e AND x.e > p.s))),
whole AS (SELECT *, bool_or(kind <> 5) OVER (PARTITION BY r, ak, a0) AND bool_or(kind = 5) OVER (PARTITION BY r, ak, a0) AS complete FROM pairs),
spans AS (SELECT r, kind, s, e FROM found WHERE kind <= 2 UNION ALL SELECT DISTINCT r, kind, s, e FROM (SELECT r, kind, s, e FROM whole WHERE complete UNION ALL SELECT r, ak, a0, a1 FROM whole WHERE complete) WHERE kind > 2)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg({name}, ',' ORDER BY s, kind, e) FILTER (kind <= 2), '')) AS base_sha256, coalesce(string_agg({name}, ',' ORDER BY s, kind, e), '') AS spans
FROM docs LEFT JOIN spans USING (r) GROUP BY r, doc_id"""


_ONE_TEXT = "SELECT doc_id, coalesce(min(text), '') AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id"
ORACLE_SQL = {
    "op2_suffix_dedup": f"""
WITH docs AS MATERIALIZED (SELECT doc_id, hex(encode(text)) AS h FROM ({_ONE_TEXT})),
blocks AS (SELECT doc_id, b, substr(h, 2 * b + 1, 1198) AS part FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0), 500)) AS b FROM docs)),
starts AS (SELECT doc_id, b, part, unnest(range(0, least(500, length(part) // 2 - 99))) AS s FROM blocks),
keyed AS MATERIALIZED (SELECT doc_id, b + s AS s, md5_number(substr(part, 2 * s + 1, 200)) AS k FROM starts),
firsts AS (SELECT k, min({{'d': doc_id, 's': s}}) AS f FROM keyed GROUP BY k HAVING count(*) > 1),
repeats AS (SELECT doc_id, s, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, -1) AS opens FROM keyed JOIN firsts USING (k) WHERE f.d <> doc_id OR f.s <> s),
islands AS (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM repeats),
spans AS MATERIALIZED (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM islands GROUP BY doc_id, i),
ends AS (SELECT doc_id, max(z) AS last FROM spans GROUP BY doc_id),
pieces AS (
  SELECT doc_id, z - a AS n, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b, a AS e FROM spans
  UNION ALL SELECT d.doc_id, NULL, coalesce(last, 0), length(h) // 2 FROM docs d LEFT JOIN ends ON d.doc_id = ends.doc_id)
SELECT d.doc_id, length(any_value(h)) // 2 AS n_bytes, coalesce(sum(n), 0)::BIGINT AS n_removed, count(n) AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' ORDER BY b))) AS kept_sha256
FROM docs d JOIN pieces p ON d.doc_id = p.doc_id GROUP BY d.doc_id""",
    "op3_minhash_dedup": f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM ({_ONE_TEXT})),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
pairs AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
links AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT x AS d, x AS c FROM links UNION SELECT y, c FROM reach JOIN links ON x = d WHERE c < y),
low AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON d = doc_id""",
    "op7_embedding_dedup": """
WITH RECURSIVE fine AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM fine),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) WHERE list_dot_product(a.u, b.u) >= 0.9),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x),
reach AS (SELECT x AS d, x AS c FROM links UNION SELECT y, c FROM reach JOIN links ON x = d WHERE c < y),
low AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN counts ON x = vec_id LEFT JOIN low ON d = vec_id""",
    "op5_line_dedup": f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT d.*, c.k IS NOT NULL AND d.doc_id <> c.keeper AS gone FROM keyed d LEFT JOIN common c ON d.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op10_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
seen AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS goes_on,
    length(text) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '<\|[A-Za-z0-9_]*\|>|</?s>|<</?SYS>>|</?SYS>>|\[/?INST\]')) AS shown
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(shown + CASE WHEN goes_on THEN 10 ELSE 12 + length(role) + 1 + 11 END)::BIGINT AS formatted_chars
FROM seen GROUP BY conv_id""",
    "op11_importance_resampling": f"""
WITH made AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
words AS MATERIALIZED (SELECT r, unnest(ws) AS w FROM rows),
aims AS MATERIALIZED (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS w FROM benchmark),
distinct_words AS MATERIALIZED (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM words UNION SELECT w FROM aims)),
buckets AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM distinct_words, made),
corpus AS (SELECT b, count(*) AS s FROM words JOIN buckets USING (w) GROUP BY b),
target AS (SELECT b, count(*) AS t FROM aims JOIN buckets USING (w) GROUP BY b),
totals AS (SELECT (SELECT count(*) FROM words)::DOUBLE AS big_s, (SELECT count(*) FROM aims)::DOUBLE AS big_t),
gains AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (big_s + 10000) / ((coalesce(s, 0) + 1) * (big_t + 10000))))::BIGINT AS g FROM corpus FULL JOIN target USING (b), totals),
weights AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS weight FROM words JOIN buckets USING (w) JOIN gains USING (b) GROUP BY r),
scored AS MATERIALIZED (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM rows LEFT JOIN weights USING (r)),
ranked AS (SELECT *, doc_id IS NOT NULL AND n_features >= 20 AS pool, row_number() OVER (PARTITION BY doc_id IS NOT NULL AND n_features >= 20 ORDER BY score DESC, doc_id, n_features, weight) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN pool AND place <= (SELECT 10 * count(*) // 100 FROM ranked WHERE pool) THEN place END AS rank FROM ranked""",
    "op12_lexical_search": rf"""
WITH found AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{lexsearch.TERM}') AS ws FROM documents),
docs AS MATERIALIZED (SELECT r, doc_id, len(ws) AS n FROM found WHERE len(ws) > 0),
stats AS MATERIALIZED (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM docs),
asked AS MATERIALIZED (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(min(text), ''), '{_UPPER}', '{_LOWER}'), '{lexsearch.TERM}')) AS t FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id) GROUP BY item_id, t),
postings AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM found) SEMI JOIN asked USING (t) GROUP BY r, t),
weights AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, stats GROUP BY t, big_n),
scored AS (SELECT item_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM postings JOIN docs USING (r) JOIN weights USING (t) JOIN asked USING (t), stats GROUP BY item_id, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored JOIN docs USING (r) WHERE score > 0 AND doc_id IS NOT NULL)
SELECT * FROM ranked WHERE rank <= 20""",
    "op13_secret_scan": _secret_sql(),
}
