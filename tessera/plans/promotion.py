"""Batches and gates of questions made of the documents' texts, columns and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import promotion as P
from tessera.plans.base import query

c = F.col

_STATES = [["NEEDS_REVIEW"], ["NEEDS_REVIEW"], ["NEEDS_VISUAL_REVIEW"], ["READY_TO_SERVE"], ["READY_TO_SERVE"], ["NEEDS_ANSWER_LINKING"], ["NEEDS_REVIEW", "NEEDS_ANSWER_LINKING"], ["NEEDS_REVIEW", "NEEDS_VISUAL_REVIEW"]]
_REASONS = [["state:NEEDS_REVIEW"], ["state:NEEDS_REVIEW"], ["state:NEEDS_VISUAL_REVIEW"]]
_READY_REASONS = [["group_context_missing"], ["inline_options_in_short_response"], ["group_membership_suspect"], ["group_context_missing"], ["render_warning"]]
_FLAGS = [[], ["not_nfc_normalized"], ["numbering_gap_in_section"], ["pdf_text_layer_fidelity"], ["pdf_text_layer_fidelity", "not_nfc_normalized"], ["answer_mapping_ambiguous"], ["unsupported_object"], ["pdf_text_layer_fidelity", "answer_from_highlight_only"]]
_NOTES = [[], [], ["possible segmentation contamination x"], ["as_watermark1", "as_watermark2"], ["low-resolution figure 3"], ["unsupported object drawing_shape"]]
_CODES = ["group_passage_missing", "answer_missing", "ocr_garbage", "unresolved_placeholder"]
_SUBJECTS, _SOURCES, _METHODS = ["math", "geography", "english", "physics", "biology"], ["original", "admin", "inferred"], ["docx_native", "pdf_text_layer", "doc->docx(libreoffice)"]

#: Three numbers of a text (its length, its blanks, where its first e is) decide for the flat columns.
_QUESTIONS = f"""SELECT doc_id, text, a, b, k, {_STATES}[a % 8 + 1] AS states, CASE WHEN a % 8 < 3 THEN {_REASONS}[a % 8 + 1] WHEN a % 8 < 5 THEN {_READY_REASONS}[b % 5 + 1] ELSE []::VARCHAR[] END AS reasons, {_FLAGS}[b % 8 + 1]::VARCHAR[] AS flags, {_NOTES}[k % 6 + 1]::VARCHAR[] AS notes,
CASE WHEN a % 8 IN (3, 4) AND b % 5 = 1 THEN 'short_response' WHEN a % 8 IN (3, 4) AND b % 4 = 0 THEN 'numeric_response' ELSE 'single_choice' END AS kind, b % 3 = 0 AS has_formula, k % 11 = 0 AS has_image, k % 13 = 0 AS has_table, {_SUBJECTS}[a % 5 + 1] AS subject, {_SOURCES}[b % 3 + 1] AS subject_source, {_METHODS}[(a + b) % 3 + 1] AS method,
CASE WHEN b % 4 = 0 THEN source END AS group_key, CASE WHEN k % 5 <> 4 THEN source END AS document_id, k % 17 = 16 AS removed, CASE WHEN b % 19 = 0 THEN 'blocked' END AS gate, CASE a % 23 WHEN 0 THEN 'own' WHEN 1 THEN 'other' END AS draft, a % 29 = 0 AS dirty,
CASE WHEN (a // 8) % 6 < 4 THEN [{{'code': {_CODES}[(a // 8) % 6 + 1], 'severity': CASE WHEN (a // 8) % 6 = 2 THEN 'warning' ELSE 'critical' END}}] ELSE [] END AS findings
FROM (SELECT *, length(text) AS a, length(text) - length(replace(text, ' ', '')) AS b, instr(text, 'e') AS k FROM documents)"""


def _questions(t):
    pick = lambda lists, n: F.get(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, list) else F.lit(x) for x in lists]), n.cast("int"))
    d = t.documents.withColumns({"a": F.length("text"), "b": F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))), "k": F.instr("text", "e")})
    a, b, k = c("a"), c("b"), c("k")
    none, row = F.array().cast("array<string>"), F.floor(a / 8) % 6
    ready = (a % 8).isin(3, 4)
    cols = {
        "states": pick(_STATES, a % 8), "reasons": F.when(a % 8 < 3, pick(_REASONS, a % 8)).when(a % 8 < 5, pick(_READY_REASONS, b % 5)).otherwise(none), "flags": pick(_FLAGS, b % 8), "notes": pick(_NOTES, k % 6),
        "kind": F.when(ready & (b % 5 == 1), "short_response").when(ready & (b % 4 == 0), "numeric_response").otherwise("single_choice"), "has_formula": b % 3 == 0, "has_image": k % 11 == 0, "has_table": k % 13 == 0,
        "subject": pick(_SUBJECTS, a % 5), "subject_source": pick(_SOURCES, b % 3), "method": pick(_METHODS, (a + b) % 3), "group_key": F.when(b % 4 == 0, c("source")), "document_id": F.when(k % 5 != 4, c("source")), "removed": k % 17 == 16, "gate": F.when(b % 19 == 0, "blocked"),
        "draft": F.when(a % 23 == 0, "own").when(a % 23 == 1, "other"), "dirty": a % 29 == 0, "findings": F.when(row < 4, F.array(F.struct(pick(_CODES, row).alias("code"), F.when(row == 2, "warning").otherwise("critical").alias("severity")))),
    }
    return d.withColumns(cols)


def _rule_sql(r: P.Rule) -> str:
    """A batch's rule as a condition."""
    said = lambda v: str(list(v)) + "::VARCHAR[]"
    tests = ["NOT removed", "gate IS NULL", "coalesce(draft, 'own') = 'own'", "NOT dirty", f"len(list_filter(findings, lambda f: f.severity = 'critical' AND f.code <> '{r.settles or ''}')) = 0", f"list_sort(states) = list_sort({said(r.states)})", f"kind = '{r.kind}'"]
    tests += [f"reasons = {said(r.reasons)}"] if r.reasons is not None else []
    tests += [f"list_has_all({said(r.flags_within)}, flags)"] if r.flags_within is not None else []
    tests += [f"list_has_any(flags, {said(r.flags_any)})"] if r.flags_any is not None else []
    tests += [f"flags = {said(r.flags_exact)}"] if r.flags_exact is not None else []
    if r.notes == "none":
        tests.append("len(notes) = 0")
    elif r.notes is not None:
        tests.append(f"len(list_filter(notes, lambda n: NOT regexp_matches(n, '{r.notes}'))) = 0")
        if r.notes_not is not None:
            tests.append(f"len(list_filter(notes, lambda n: NOT regexp_matches(n, '{r.notes_not}'))) > 0")
        elif "watermark" not in r.notes:
            tests.append("len(notes) > 0")
    tests += [f"{k} = {v}" for k, v in (("has_formula", r.formula), ("has_image", r.image), ("has_table", r.table)) if v is not None]
    tests += [f"list_contains({said(v)}, {k})" for k, v in (("subject_source", r.subject_sources), ("subject", r.subjects), ("method", r.methods)) if v is not None]
    tests += [f"NOT list_contains({said(r.methods_not)}, method)"] if r.methods_not else []
    tests += ["group_key IS NULL"] * r.no_group + ["document_id IS NOT NULL"] * r.document
    tests += [f"len(list_filter(findings, lambda f: list_contains({said(r.without_findings)}, f.code))) = 0"] if r.without_findings else []
    return " AND ".join(tests)


_BATCHED = "SELECT *, unnest(names) AS batch FROM (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {_rule_sql(r)} THEN '{r.name}' END" for r in P.RULES) + f"], lambda n: n IS NOT NULL) AS names FROM ({_QUESTIONS}))"


@query(f"SELECT doc_id, batch FROM ({_BATCHED})")
def e12_all_batches(t):
    return P.named_batches(_questions(t)).select("doc_id", "batch")


def _re(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)").replace("'", "''")


#: Texts with what the checks look for where words of the corpus were.
_WORDED = [(" the ", " A. "), (" of ", " B. "), (" that ", " C. "), (" de ", " theo hình "), (" die ", " biểu đồ "), (" la ", " bảng sau "), (" que ", " đoạn "), (" and ", " -> "), (" der ", " sơ đồ "), (", ", ",      ")]


def _worded_sql() -> str:
    x = "substr(text, 1, 3000)"
    for old, new in _WORDED[:-1]:
        x = f"replace({x}, '{old}', '{new}')"
    return f"CASE WHEN k % 7 = 0 THEN replace({x}, ', ', ',      ') ELSE {x} END"


_PARTS = f"SELECT *, ls[1] AS stem, CASE WHEN kind = 'numeric_response' AND b % 8 <> 0 THEN []::VARCHAR[] ELSE ls[2:5] END AS options, CASE WHEN b % 2 = 0 THEN ls[6] END AS passage, has_image OR has_table AS visual FROM (SELECT *, string_split({_worded_sql()}, chr(10)) AS ls FROM (FROM_HERE))"
_STRUCTURE = f"""CASE WHEN kind = 'numeric_response' THEN CASE WHEN len(options) > 0 THEN 'numeric_with_options:' || len(options) WHEN regexp_matches(coalesce(stem, ''), '{_re(P.OPTION_LIST)}') THEN 'numeric_stem_with_list' END WHEN len(options) <> 4 THEN 'option_count:' || len(options)
ELSE list_filter(list_transform(options, lambda o, i: CASE WHEN regexp_matches(o, '{_re(P.OPTION_LIST)}') THEN 'option_with_list:' || i WHEN regexp_matches(o, '{_re(P.LABEL_LINE)}') THEN 'option_with_label_line:' || i END), lambda x: x IS NOT NULL)[1] END"""
_NAMED = f"nullif(lower(regexp_extract(coalesce(stem, '') || ' ' || coalesce(passage, ''), '{_re(P.FIGURE_HINT)}', 1)), '')"
_INCOMPLETE = f"""CASE WHEN regexp_matches(coalesce(stem, ''), '{P.LINE_GAP}') THEN 'gap_in_line' WHEN {_NAMED} IS NOT NULL AND NOT visual AND NOT (starts_with({_NAMED}, 'sơ đồ') AND regexp_matches(coalesce(stem, '') || ' ' || coalesce(passage, '') || ' ' || array_to_string(options, ' '), '{P.ARROW}')) THEN 'refers_to:' || {_NAMED} END"""
_EXHIBIT = f"CASE WHEN regexp_matches(coalesce(stem, ''), '{_re(P.EXHIBIT)}') AND NOT visual THEN 'cites:' || lower(regexp_extract(stem, '{_re(P.EXHIBIT)}', 1)) END"


def _parts(q):
    body = F.substring("text", 1, 3000)
    for old, new in _WORDED[:-1]:
        body = F.replace(body, F.lit(old), F.lit(new))
    q = q.withColumn("body", body).withColumn("ls", F.split(F.when(c("k") % 7 == 0, F.replace("body", F.lit(", "), F.lit(",      "))).otherwise(c("body")), "\n", -1))
    at = lambda n: F.get("ls", F.lit(n))
    numeric = (c("kind") == "numeric_response") & (c("b") % 8 != 0)
    return q.withColumns({"stem": at(0), "options": F.when(numeric, F.array().cast("array<string>")).otherwise(F.slice("ls", 2, 4)), "passage": F.when(c("b") % 2 == 0, at(5)), "visual": c("has_image") | c("has_table")})


@query(f"SELECT doc_id, {_STRUCTURE} AS structure, {_INCOMPLETE} AS incomplete, {_EXHIBIT} AS exhibit FROM ({_PARTS.replace("FROM_HERE", _QUESTIONS)})")
def e6_structure_checks(t):
    q = _parts(_questions(t))
    return q.select("doc_id", P.structure_problem(c("kind"), c("options"), c("stem")).alias("structure"), P.incomplete(F.array("stem"), c("stem"), c("passage"), c("options"), c("visual")).alias("incomplete"), P.missing_exhibit(c("stem"), c("visual")).alias("exhibit"))


_HEADERS = ["Questions 3 - 7: (Choose a suitable word or phrase (marked A, B, C, D) to fill in each blank)", "Đọc và trả lời các câu hỏi 12", "Each of the following sentences has one error (A, B, C or D). Find it and blacken your choice on your answer sheet", "Read this"]
_HEADER = f"{_HEADERS}[k % 4 + 1] || CASE WHEN b % 9 = 0 THEN substr(coalesce(stem, ''), 1, 30) ELSE '' END"
_PLAIN_HEADER = f"trim(regexp_replace(regexp_replace({_HEADER}, '[0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_REFERS = f"nullif(lower(regexp_extract(coalesce(stem, ''), '{_re(P.CONTEXT_REF)}', 1)), '')"
_LETTERS = r"length(regexp_replace(coalesce(stem, ''), '[^\p{L}]+', '', 'g'))"
_GROUPED = "CASE WHEN b % 6 = 0 THEN passage END"
_INSTRUCTION = f"""CASE WHEN coalesce({_GROUPED}, '') <> '' THEN 'has_passage' WHEN NOT regexp_matches({_PLAIN_HEADER}, '{_re(P.GROUP_INSTRUCTION)}') THEN 'not_plain_instruction' WHEN {_LETTERS} < 15 THEN 'stem_too_short' WHEN {_REFERS} IS NOT NULL THEN 'refers_to:' || {_REFERS} WHEN contains(lower({_PLAIN_HEADER}), 'has one error') AND b % 5 < 3 THEN 'no_marked_parts' END"""
_COUNTS = "[{{'subject': 'math', 'score': (length({x}) - length(replace({x}, 'er', ''))) // 2}}, {{'subject': 'history', 'score': (length({x}) - length(replace({x}, 'ont', ''))) // 3}}, {{'subject': 'biology', 'score': (length({x}) - length(replace({x}, 'queí', ''))) // 4}}]"


def _best(x: str) -> str:
    return f"list_filter({x}, lambda s: s.score = list_max(list_transform({x}, lambda y: y.score)))[1]"


_P, _Q = _COUNTS.format(x="coalesce(passage, '')"), _COUNTS.format(x="substr(coalesce(stem, ''), 1, 60)")
_APART = f"""CASE WHEN trim(coalesce(passage, '')) = '' THEN 'no_passage' WHEN {_REFERS} IS NOT NULL THEN 'refers_to:' || {_REFERS} WHEN {_LETTERS} < 25 THEN 'stem_too_short'
WHEN {_best(_P)}.score < 1 OR {_best(_Q)}.score < 1 OR {_best(_P)}.subject = {_best(_Q)}.subject OR list_filter({_Q}, lambda s: s.subject = {_best(_P)}.subject)[1].score > 0 OR list_filter({_P}, lambda s: s.subject = {_best(_Q)}.subject)[1].score > 0 THEN 'subjects_alike' END"""


def _scores(text):
    x = F.coalesce(text, F.lit(""))
    count = lambda part: F.floor((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part))
    return F.array(*[F.struct(F.lit(s).alias("subject"), count(part).alias("score")) for s, part in (("math", "er"), ("history", "ont"), ("biology", "queí"))])


def _header(q):
    return F.concat(F.get(F.array(*map(F.lit, _HEADERS)), c("k") % 4), F.when(c("b") % 9 == 0, F.substring(F.coalesce("stem", F.lit("")), 1, 30)).otherwise(""))


def _instruction(q):
    return P.instruction_problem(_header(q), c("stem"), F.when(c("b") % 6 == 0, c("passage")), c("b") % 5)


@query(f"SELECT doc_id, {_INSTRUCTION} AS instruction, {_APART} AS apart FROM ({_PARTS.replace("FROM_HERE", _QUESTIONS)})")
def e7_group_checks(t):
    q = _parts(_questions(t))
    return q.select("doc_id", _instruction(q).alias("instruction"), P.passage_problem(c("passage"), c("stem"), _scores(c("passage")), _scores(F.substring("stem", 1, 60))).alias("apart"))


_KEY = "regexp_replace(lower({}), '[^\\p{{L}}]+', '', 'g')"
_SOURCE = f"""SELECT doc_id, {_KEY.format("array_to_string(ls[:2], '')")} || {_KEY.format("ls[3]")} || {_KEY.format("CASE WHEN length(ls[4]) % 3 = 0 THEN ls[4] ELSE '' END")} || 'question' || {_KEY.format("ls[5]")} || {_KEY.format("ls[6]")} AS src, {_KEY.format("ls[3]")} AS hdr, substr({_KEY.format("ls[6]")}, 1, 40) AS lead, [substr({_KEY.format("ls[5]")}, 1, 40), substr({_KEY.format("ls[4]")}, 1, 9)] AS members
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) WHERE len(ls) >= 6"""


@query(f"""WITH s AS ({_SOURCE}), f AS (SELECT *, instr(src, lead) AS pos FROM s), h AS (SELECT *, CASE WHEN pos > 0 THEN list_max(list_filter(range(1, pos), lambda i: i + length(hdr) <= pos AND substr(src, i, length(hdr)) = hdr)) END AS h FROM f),
m AS (SELECT *, h + length(hdr) AS z, list_transform(members, lambda m: CASE WHEN length(m) >= 12 AND instr(substr(src, h + length(hdr)), m) > 0 THEN instr(substr(src, h + length(hdr)), m) + h + length(hdr) - 1 END) AS at_ FROM h),
g AS (SELECT *, least(pos, coalesce(list_min(list_filter(list_transform(at_, lambda k, i: CASE WHEN k + length(members[i]) <= pos THEN k END), lambda k: k IS NOT NULL)), pos)) AS first FROM m),
l AS (SELECT *, length(regexp_replace(regexp_replace(substr(src, z, greatest(first - z, 0)), '[0-9]+', '', 'g'), '(questions?|cau|tu|den|to|from)', '', 'g')) AS n FROM g)
SELECT doc_id, CASE WHEN length(lead) < 12 OR pos = 0 OR length(hdr) < 12 THEN 'not_located' WHEN h IS NULL OR pos - h > 60000 THEN 'instruction_not_found' WHEN n > 30 THEN 'text_between:' || n END AS lost FROM l""")
def e7_lost_passage(t):
    key = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}]+", "")
    d = t.documents.select("doc_id", F.split("text", "\n", -1).alias("ls")).where(F.size("ls") >= 6)
    line = lambda n: F.get("ls", F.lit(n))
    source = F.concat(key(F.concat(line(0), line(1))), key(line(2)), key(F.when(F.length(line(3)) % 3 == 0, line(3))), F.lit("question"), key(line(4)), key(line(5)))
    d = d.select("doc_id", source.alias("src"), key(line(2)).alias("hdr"), F.substring(key(line(5)), 1, 40).alias("lead"), F.array(F.substring(key(line(4)), 1, 40), F.substring(key(line(3)), 1, 9)).alias("members"))
    return d.select("doc_id", P.lost_passage(c("src"), c("hdr"), c("lead"), c("members")).alias("lost"))


def _among(names: set) -> str:
    return "batch IN (" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"


_GATED = f"""SELECT batch, doc_id, coalesce(CASE WHEN NOT {_among(P.SPLIT | P.DIALOGUE)} THEN {_STRUCTURE} END, {_INCOMPLETE}, CASE WHEN document_id IS NULL THEN 'source_not_available' END, CASE WHEN {_among(P.GROUP)} THEN {_INSTRUCTION} END, CASE WHEN {_among(P.DETACH)} THEN {_APART} END,
CASE WHEN {_among(P.PDF_TEXT)} THEN {_EXHIBIT} END, CASE WHEN length(coalesce(stem, '')) < 12 THEN 'stem_too_short' END, CASE WHEN {_among(P.ANSWERS)} AND k % 2 = 0 THEN 'answer_pending' END, CASE WHEN {_among(P.VISUALS)} AND k % 4 < 2 THEN 'visual_pending' END) AS reason FROM ({_PARTS.replace("FROM_HERE", _BATCHED)})"""


def _gated(t):
    q = _parts(P.named_batches(_questions(t)))
    every = {r.name for r in P.RULES}
    gates = [
        (every - P.SPLIT - P.DIALOGUE, P.structure_problem(c("kind"), c("options"), c("stem"))),
        (None, P.incomplete(F.array("stem"), c("stem"), c("passage"), c("options"), c("visual"))),
        (None, F.when(c("document_id").isNull(), "source_not_available")),
        (P.GROUP, _instruction(q)),
        (P.DETACH, P.passage_problem(c("passage"), c("stem"), _scores(c("passage")), _scores(F.substring("stem", 1, 60)))),
        (P.PDF_TEXT, P.missing_exhibit(c("stem"), c("visual"))),
        (None, F.when(F.length(F.coalesce("stem", F.lit(""))) < 12, "stem_too_short")),
        (P.ANSWERS, F.when(c("k") % 2 == 0, "answer_pending")),
        (P.VISUALS, F.when(c("k") % 4 < 2, "visual_pending")),
    ]
    return q.select("batch", "doc_id", P.first_failing_gate(c("batch"), gates).alias("reason"))


@query(_GATED)
def e13_gate_chain(t):
    return _gated(t)


@query(f"SELECT batch, coalesce(split_part(reason, ':', 1), 'promoted') AS reason, count(*) AS n FROM ({_GATED}) GROUP BY 1, 2")
def e13_gate_report(t):
    return P.gate_report(_gated(t))
