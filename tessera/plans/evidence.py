"""Evidence checks, stem fixes, filter columns and resumed imports on rows made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cdc
from tessera.operators import evidence as E
from tessera.plans.base import query

c = F.col
#: The first lines of a document, which stand for the parts of a question.
_LINES = "SELECT *, string_split(text, chr(10)) AS ls, length(text) AS n FROM documents"


def _lines(t):
    return t.documents.withColumns({"ls": F.split("text", "\n", -1), "n": F.length("text")})


def _line(k: int):
    return F.get("ls", F.lit(k))


def _re2(pattern: str) -> str:
    """A pattern for RE2: no Unicode flag, no look-behind, so a word's edge is the character before or behind it."""
    for old, new in (("(?iuU)", "(?i)"), ("(?iu)", "(?i)"), ("(?U)", ""), (r"\d\p{L}(?<![đ])", r"\d[^\P{L}đ]"), (r"(?<!\w)", r"(?:^|[^\p{L}\p{N}_])"), (r"(?!\w)", r"(?:$|[^\p{L}\p{N}_])"), ("'", "''")):
        pattern = pattern.replace(old, new)
    return pattern


#: A solution that begins with its stem, with the stem's first part, with another spelling of it, or with something else.
_SOLVED = "CASE n % 6 WHEN 0 THEN ls[1] || '  ' || coalesce(ls[2], '') WHEN 1 THEN ls[1] WHEN 2 THEN substr(ls[1], 1, length(ls[1]) // 2) || coalesce(ls[2], '') WHEN 3 THEN substr(ls[1], 1, length(ls[1]) * 9 // 10) || coalesce(ls[2], '') WHEN 4 THEN replace(ls[1], 'ou', 'uo') ELSE ls[2] END"


@query(f"""SELECT doc_id, CASE WHEN length(stem) >= 40 AND k >= 0.8 * length(stem) THEN nullif(regexp_replace(substr(solution, k + 1), '^\\s+', ''), '') ELSE nullif(solution, '') END AS rest
FROM (SELECT *, len(list_filter(range(1, least(length(stem), length(solution)) + 1), lambda i: substr(stem, 1, i) = substr(solution, 1, i))) AS k FROM (SELECT doc_id, ls[1] AS stem, {_SOLVED} AS solution FROM ({_LINES})))""")
def c13_strip_echo(t):
    n, stem, other = c("n") % 6, _line(0), F.coalesce(_line(1), F.lit(""))
    head = lambda share: F.substr(stem, F.lit(1), F.floor(F.length(stem) * share).cast("int"))
    solution = F.when(n == 0, F.concat(stem, F.lit("  "), other)).when(n == 1, stem).when(n == 2, F.concat(head(0.5), other)).when(n == 3, F.concat(F.substr(stem, F.lit(1), F.floor(F.length(stem) * 9 / 10).cast("int")), other)).when(n == 4, F.replace(stem, F.lit("ou"), F.lit("uo"))).otherwise(_line(1))
    return _lines(t).select("doc_id", E.strip_stem_echo(stem, solution).alias("rest"))


#: Keys: the last line with other stops and blanks around it, its begin, or nothing.
_KEYED = "CASE n % 5 WHEN 0 THEN ' ' || ls[-1] || '..' WHEN 1 THEN regexp_replace(ls[-1], '\\.+$', '') WHEN 2 THEN substr(ls[-1], 1, 5) WHEN 3 THEN ' ' ELSE NULL END"
_BARE = r"regexp_replace(trim({}), '\.+$', '')"


@query(f"""SELECT doc_id, array_to_string(CASE WHEN hit THEN ls[:-2] ELSE ls END, '|') AS stem, CASE WHEN hit THEN {_BARE.format("ls[-1]")} END AS key FROM (SELECT *, coalesce(provided AND len(ls) >= 2 AND trim(key) <> '' AND {_BARE.format("ls[-1]")} = {_BARE.format("key")}, false) AS hit
FROM (SELECT doc_id, n, ls, {_KEYED} AS key, n % 4 <> 0 AS provided FROM (SELECT doc_id, n, ls[1:3] AS ls FROM ({_LINES}))))""")
def k12_printed_key(t):
    d = _lines(t).withColumn("ls", F.slice("ls", 1, 3))
    n, last = c("n") % 5, F.element_at("ls", -1)
    key = F.when(n == 0, F.concat(F.lit(" "), last, F.lit(".."))).when(n == 1, F.regexp_replace(last, r"\.+$", "")).when(n == 2, F.substring(last, 1, 5)).when(n == 3, " ")
    x = E.strip_printed_key(c("ls"), key, c("n") % 4 != 0)
    return d.select("doc_id", x.alias("x")).select("doc_id", F.array_join("x.stem", "|").alias("stem"), c("x.key").alias("key"))


#: Formulas: the begins of texts, with commands, brackets and braces where words of the corpus were.
_TEX = [(" the ", r" \dfrac{a}{{b}} + "), (" of ", r" \times "), (" de ", r"\left( {x} \right)"), (" la ", " − {\\pi} "), (" die ", r"\tfrac{12}{{{y}}}"), (" in ", "~3,5 "), (" and ", r"\cdot\, z"), (" der ", " $ ")]


def _tex_sql() -> str:
    x = "substr(text, 1, 160)"
    for old, new in _TEX:
        x = f"replace({x}, '{old}', '{new}')"
    return f"CASE WHEN n % 3 = 0 THEN '$$' || {x} || '$' ELSE {x} END"


def _after(x: str, *steps: tuple[str, str]) -> str:
    for old, new in steps:
        x = f"regexp_replace({x}, '{old}', '{new}', 'g')"
    return x


_TEX_FLAT = _after("translate(replace(replace(" + _after("trim(raw)", (r"^\$+|\$+$", ""), (r"\\(?:left|right)\b", ""), (r"\\[dt]frac", r"\\frac")) + r", '\cdot', '*'), '\times', '*'), '−,', '-.')", (r"\\[,;:! ]|~", ""), (r"\s+", ""))


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, {_TEX_FLAT} AS tex FROM (SELECT doc_id, {_tex_sql()} AS raw FROM ({_LINES}))), r AS (SELECT doc_id, 0 AS i, tex FROM t UNION ALL SELECT doc_id, i + 1, regexp_replace(tex, '\\{{(\\\\?[A-Za-z0-9])\\}}', '\\1', 'g') FROM r WHERE regexp_matches(tex, '\\{{(\\\\?[A-Za-z0-9])\\}}'))
SELECT doc_id, arg_max(tex, i) AS tex FROM r GROUP BY doc_id""")
def c26_norm_tex(t):
    raw = F.substring("text", 1, 160)
    for old, new in _TEX:
        raw = F.replace(raw, F.lit(old), F.lit(new))
    d = t.documents.select("doc_id", F.length("text").alias("n"), raw.alias("raw"))
    return d.select("doc_id", E.norm_tex(F.when(c("n") % 3 == 0, F.concat(F.lit("$$"), c("raw"), F.lit("$"))).otherwise(c("raw"))).alias("tex"))


#: Options: four lines cut short; solutions: one of them in other words, by letter, or too little.
_OPTS = "list_transform(ls[2:5], lambda o: substr(o, 1, 60))"
_TOLD = "CASE n % 7 WHEN 0 THEN 'B. ' || os[2] WHEN 1 THEN substr(os[3], 1, 20) WHEN 2 THEN replace(os[n % 4 + 1], 'ou', 'o') ELSE 'Vì ' || os[n % 4 + 1] || '.' END"
_LONG = r"list_filter(regexp_extract_all(lower(o), '[\p{L}\p{N}]+'), lambda w: length(w) > 1)"


@query(rf"""WITH q AS MATERIALIZED (SELECT doc_id, n, {_OPTS} AS os, CASE WHEN n % 11 = 0 THEN 'Câu nào không đúng?' ELSE 'Câu nào đúng?' END AS stem FROM ({_LINES}) WHERE len(ls) >= 5),
s AS MATERIALIZED (SELECT *, {_TOLD} AS solution, regexp_replace(lower({_TOLD}), '[^\p{{L}}\p{{N}}]+', '', 'g') AS flat FROM q),
o AS (SELECT doc_id, unnest(os) AS o, unnest(['A', 'B', 'C', 'D']) AS label, flat FROM s),
r AS (SELECT doc_id, label, len(ws) AS words, coalesce(len(list_filter(ws, lambda w: contains(flat, w)))::DOUBLE / nullif(len(ws), 0), 0) AS share FROM (SELECT *, {_LONG} AS ws FROM o)),
b AS (SELECT doc_id, arg_max(label, (share, -ascii(label))) AS best, max(share) AS top, max(share) FILTER (label = 'A') AS own, min(words) AS least FROM r GROUP BY 1)
SELECT doc_id, CASE WHEN length(flat) >= 30 AND NOT contains(stem, 'không') AND NOT regexp_matches(solution, '{_re2(E.BY_LETTER)}') AND least >= 4 AND best <> 'A' AND top >= 0.85 AND own <= top - 0.3 THEN best END AS suggested FROM s JOIN b USING (doc_id)""")
def e5_contradiction(t):
    d = _lines(t).where(F.size("ls") >= 5).withColumn("os", F.transform(F.slice("ls", 2, 4), lambda o: F.substring(o, 1, 60)))
    one, n = F.get("os", c("n") % 4), c("n") % 7
    solution = F.when(n == 0, F.concat(F.lit("B. "), F.get("os", F.lit(1)))).when(n == 1, F.substring(F.get("os", F.lit(2)), 1, 20)).when(n == 2, F.replace(one, F.lit("ou"), F.lit("o"))).otherwise(F.concat(F.lit("Vì "), one, F.lit(".")))
    stem = F.when(c("n") % 11 == 0, "Câu nào không đúng?").otherwise("Câu nào đúng?")
    return d.select("doc_id", E.contradicting_option(F.lit("A"), F.array(*map(F.lit, "ABCD")), c("os"), stem, solution).alias("suggested"))


@query("""SELECT p_partkey, CASE WHEN subject IS NULL OR subject = 'general' OR source = 'unclassified' THEN 'unclassified' WHEN mine >= 2 AND mine >= most - 1 THEN 'content' WHEN section = subject AND NOT against THEN 'section' WHEN section <> subject AND in_section >= mine THEN 'section_conflict'
WHEN top = subject AND mine >= 1 AND NOT against THEN 'leaning' WHEN trusted AND NOT against AND (mine >= 1 OR most = 0) AND NOT (subject = 'math' AND mine = 0 AND bare) THEN 'classification' WHEN most = 0 THEN 'unverified' ELSE 'content_conflict' END AS reason
FROM (SELECT *, most >= 3 AND top <> subject AND most >= mine + 3 AS against FROM (SELECT *, CASE subject WHEN 'art' THEN a WHEN 'math' THEN m WHEN 'zoology' THEN z ELSE 0 END AS mine, CASE section WHEN 'art' THEN a WHEN 'math' THEN m ELSE 0 END AS in_section, greatest(a, m, z) AS most, CASE WHEN a >= m AND a >= z THEN 'art' WHEN m >= z THEN 'math' ELSE 'zoology' END AS top
FROM (SELECT p_partkey, (p_partkey % 5)::INT AS a, (p_size % 4)::INT AS m, (p_size % 7)::INT AS z, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'general' WHEN 2 THEN 'art' WHEN 3 THEN 'math' WHEN 4 THEN 'zoology' WHEN 5 THEN 'math' ELSE 'art' END AS subject,
CASE WHEN p_size % 11 = 0 THEN 'unclassified' ELSE 'original' END AS source, p_size % 3 = 0 AS trusted, CASE p_partkey % 3 WHEN 0 THEN 'art' WHEN 1 THEN 'math' END AS section, p_partkey % 2 = 0 AS bare FROM part)))""")
def e8_subject_verdict(t):
    n, s = c("p_partkey"), c("p_size")
    scores = F.create_map(F.lit("art"), (n % 5).cast("int"), F.lit("math"), (s % 4).cast("int"), F.lit("zoology"), (s % 7).cast("int"))
    subject = F.when(n % 7 == 1, "general").when((n % 7).isin(2, 6), "art").when((n % 7).isin(3, 5), "math").when(n % 7 == 4, "zoology")
    section = F.when(n % 3 == 0, "art").when(n % 3 == 1, "math")
    v = E.subject_verdict(subject, F.when(s % 11 == 0, "unclassified").otherwise("original"), F.when(s % 3 == 0, "high").otherwise("low"), scores, section, n % 2 == 0)
    return t.part.select("p_partkey", v["reason"].alias("reason"))


#: Stems: the first lines, with labels where words of the corpus were.
_LABELLED = [(" the ", "\n A. "), (" de ", "\n A. "), (" of ", " B. "), (" la ", " B. "), (" that ", " C. "), (" le ", " C. "), (" in ", " D. "), (" des ", " D. ")]


def _labelled_sql() -> str:
    x = "substr(text, 1, 2500)"
    for old, new in _LABELLED:
        x = f"replace({x}, '{old}', '{new}')"
    return x


_PART = "regexp_extract(stem, '" + E.INLINE_OPTIONS.replace("'", "''") + "', {})"


@query(f"""SELECT doc_id, CASE WHEN hit THEN {_PART.format(1)} END AS stem, CASE WHEN hit THEN {_PART.format(2)} || '|' || {_PART.format(3)} || '|' || {_PART.format(4)} || '|' || {_PART.format(5)} END AS options
FROM (SELECT *, regexp_matches(stem, '{E.INLINE_OPTIONS}') AND n % 5 <> 0 AS hit FROM (SELECT doc_id, n, {_labelled_sql()} AS stem FROM ({_LINES})))""")
def e10_inline_options(t):
    stem = F.substring("text", 1, 2500)
    for old, new in _LABELLED:
        stem = F.replace(stem, F.lit(old), F.lit(new))
    x = E.inline_options(stem, F.when(F.length("text") % 5 == 0, "12").otherwise(" C"))
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", c("x.stem").alias("stem"), F.array_join("x.options", "|").alias("options"))


@query("SELECT doc_id, coalesce(source, '') AS doc_path, CASE WHEN n_chars BETWEEN 0 AND 999 THEN n_chars ELSE 0 END AS source_number, substr(lower(text), 1, 4000) AS search_text, doc_id % 9 <> 0 AND NOT (lang = 'de') AS active FROM documents")
def q10_filter_columns(t):
    number = F.when(c("n_chars").between(0, 999), c("n_chars")).otherwise(F.lit(0)).cast("long")
    return t.documents.select("doc_id", F.coalesce("source", F.lit("")).alias("doc_path"), number.alias("source_number"), F.substring(F.lower("text"), 1, 4000).alias("search_text"), ((c("doc_id") % 9 != 0) & ~(c("lang") == "de")).alias("active"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 7 = 0 AND o_orderdate < TIMESTAMP '1996-01-01')")
def m7_resume(t):
    done = t.orders.where((c("o_orderkey") % 7 == 0) & (c("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))).select(F.lit("now").alias("fingerprint"), c("o_orderkey").alias("last_key"))
    other = t.orders.select(F.lit("before").alias("fingerprint"), c("o_orderkey").alias("last_key"))
    return cdc.pending(t.orders.select("o_orderkey"), done.union(other), "o_orderkey", "now")


@query(r"SELECT doc_id, array_to_string(stored, ',') AS stored, array_to_string(flags, ',') AS flags FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [] ELSE ['mail'] END AS stored, list_sort(list_filter([CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END], lambda x: x IS NOT NULL)) AS flags FROM documents) WHERE array_to_string(stored, ',') <> array_to_string(flags, ',')")
def p6_recompute_flags(t):
    computed = F.array_compact(F.array(F.when(c("text").contains("@"), "mail"), F.when(c("text").rlike("[0-9]"), "digits")))
    docs = t.documents.withColumn("stored", F.when(c("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("mail"))))
    return cdc.changed_flags(docs, "doc_id", "stored", computed).select("doc_id", F.array_join("stored", ",").alias("stored"), F.array_join("flags", ",").alias("flags"))


#: Headers: begins of texts with numbers from their lengths between them, in several ways of writing a range.
_BEGIN, _RANGED = "substr(text, 1, 12)", "CASE n % 6 WHEN 0 THEN '{b} câu hỏi số {x} đến câu {y} {b}' WHEN 1 THEN '{b} Questions {x} and {y}.' WHEN 2 THEN 'từ câu {x} - {y} {b}' WHEN 3 THEN 'from question {x} to {y}' WHEN 4 THEN '{x} tới {y} {b}' ELSE 'CÂU {x}–{y}, questions {y}-{x}' END"


@query(f"""SELECT doc_id, CASE WHEN low <= high THEN low END AS low, CASE WHEN low <= high THEN high END AS high, regexp_replace(regexp_replace(header, '{_re2(E.SHOWN_RANGES[0])}', '{{{{range}}}}', 'g'), '{_re2(E.SHOWN_RANGES[1])}', '{{{{range}}}}', 'g') AS neutral
FROM (SELECT *, try_cast(nullif(regexp_extract(header, '{_re2(E.HEADER_RANGE)}', 1), '') AS INT) AS low, try_cast(nullif(regexp_extract(header, '{_re2(E.HEADER_RANGE)}', 2), '') AS INT) AS high
FROM (SELECT doc_id, replace(replace(replace({_RANGED}, '{{x}}', (n // 6 % 150)::VARCHAR), '{{y}}', (n // 7 % 150)::VARCHAR), '{{b}}', {_BEGIN}) AS header FROM ({_LINES})))""")
def c11_header_range(t):
    n = c("n")
    header = F.expr(_RANGED)
    for mark, value in (("{x}", F.floor(n / 6) % 150), ("{y}", F.floor(n / 7) % 150), ("{b}", F.substring("text", 1, 12))):
        header = F.replace(header, F.lit(mark), value.cast("string"))
    x = E.header_range(c("header"))
    return _lines(t).select("doc_id", header.alias("header")).select("doc_id", x["low"].alias("low"), x["high"].alias("high"), E.neutral_header(c("header")).alias("neutral"))


#: Lines of texts cut at blanks of a few kinds, so that short, numeric and mathematical ones come up.
_PLAIN = [(" the ", " log "), (" of ", "\n12\n"), (" de ", " = "), (" la ", "\nab\n"), (" die ", " x2 "), (" und ", " 12 Na "), (" que ", " Trang 7 "), (" en ", "\n- - -\n")]


def _plain_sql() -> str:
    x = "substr(text, 1 + n % 40, 60)"
    for old, new in _PLAIN:
        x = f"replace({x}, '{old}', '{new}')"
    return x


_WHY = "CASE WHEN length(x) <= 3 AND NOT regexp_matches(x, '^(?:[A-D]?\\.?|\\d+[.,]?)$') THEN 'stray_fragment' WHEN regexp_matches(x, '^[^\\p{L}_]+$') AND NOT regexp_matches(x, '^\\d+(?:[.,]\\d+)?\\s*%?\\.?$') THEN 'symbol_line' " + " ".join(f"WHEN regexp_matches(x, '{_re2(p)}') THEN '{k}'" for k, p in E.FLATTENED) + " END"


@query(f"""SELECT doc_id, CASE WHEN len(ls) > 1 AND len(list_filter(ls, lambda x: regexp_matches(x, '^[\\d\\s.,]+$'))) > 0 THEN 'number_line' ELSE list_filter(list_transform(ls, lambda x: {_WHY}), lambda r: r IS NOT NULL)[1] END AS reason
FROM (SELECT doc_id, list_filter(list_transform(string_split({_plain_sql()}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM (SELECT *, length(text) AS n FROM documents))""")
def c23_flattened_math(t):
    part = F.substring(c("text"), 1 + F.length("text") % 40, F.lit(60))
    for old, new in _PLAIN:
        part = F.replace(part, F.lit(old), F.lit(new))
    return t.documents.select("doc_id", E.flattened_math(F.split(part, "\n", -1)).alias("reason"))
