"""Batches of questions that one cause keeps back, and the gates that each must pass: expressions over flat columns.

A batch is a row of ``RULES``; all batches of a question come from one pass over its columns. The gates of a batch are tried in
their order; the first that fails is the question's reason. Odd input: null flags are false, null arrays and texts empty, so
that a question never passes a gate for want of data; a question may be in several batches, and has a reason in each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------- fixed values
#: An option list inside a text, a line that begins with an option's label.
OPTION_LIST = r"(?s)(?:^|\s)A[.)]\s.+?\sB[.)]\s.+?\sC[.)]\s"
LABEL_LINE = r"\n\s*\**[A-H][.)]\s"
#: Fixed value: what a lost drawing leaves inside a line.
LINE_GAP = r"\S {5,}\S"
#: A text that refers to a figure or table, one whose scheme is written out.
FIGURE_HINT = r"(?iu)(sơ đồ|hình vẽ|hình bên|hình dưới|như hình (?:vẽ|bên|dưới|sau)|theo hình|đồ thị (?:sau|bên|dưới|như)|bảng sau|bảng số liệu|bảng dưới|biểu đồ|quan sát hình|cho hình)"
SCHEME, ARROW = "sơ đồ", r"[→⟶⇒]|->"
#: Fixed value: a stem that cites an exhibit which a text layer cannot carry.
EXHIBIT = r"(?iu)(kết quả (?:như )?(?:sau|dưới đây)|bảng (?:số liệu|sau|dưới|bên)|(?:biểu đồ|sơ đồ|lược đồ|đồ thị) (?:sau|dưới|bên)|hình (?:vẽ|bên|dưới|sau)|như hình)"
#: Headers that are an instruction and nothing else; stems that lean on what is not in the question.
GROUP_INSTRUCTION = r"(?iu)^[^\p{L}\p{N}_]*(?:questions?[^\p{L}\p{N}_]*)?(?:\(\s*)?(?:which of the following best restates each of the given sentences|each of the following sentences has one error \(a, b, c,? (?:or )?d\)\. find it and blacken your choice on your answer sheet|choose a suitable word or phrase \((?:marked )?a, b, c,? (?:or )?d\) to fill in each blank|(?:đọc và )?trả lời các câu hỏi)[^\p{L}\p{N}_]*$"
CONTEXT_REF = r"(?iu)(passage|paragraph|the text|the author|the writer|according to|in line [0-9]|the (?:article|extract|reading)|đoạn|bài đọc|bài thơ|văn bản|tác giả|nhân vật|ngữ liệu|thông tin (?:trên|đã cho|được cung cấp)|dữ liệu|bảng|biểu đồ|hình|theo (?:bài|đoạn|văn bản|thông tin)|trên đây|nêu trên|ở trên|câu chuyện)"
#: Least letters of a stem that stands alone in a group, and apart from its passage; marked parts of an error question.
ALONE, APART, MARKED = 15, 25, 3
#: Least keys to look for, how far an instruction may be from its question, words of an instruction, text left over.
LEAD, LEAST_LEAD, INSTRUCTION_BACK, LEFT_OVER = 40, 12, 60_000, 30
FILLER_WORDS = "(questions?|cau|tu|den|to|from)"


@dataclass(frozen=True)
class Rule:
    """What a batch asks of a question, besides what all ask. None asks nothing; a tuple of states, reasons is exact."""

    name: str
    states: tuple = ("NEEDS_REVIEW",)
    reasons: tuple | None = None
    flags_within: tuple | None = None
    flags_any: tuple | None = None
    flags_exact: tuple | None = None
    notes: str | None = None  # 'none', or a pattern that all notes match; 'some' and a pattern that not all match in notes_not
    notes_not: str | None = None
    kind: str = "single_choice"
    formula: bool | None = False
    image: bool | None = None
    table: bool | None = None
    subject_sources: tuple | None = None
    subjects: tuple | None = None
    methods: tuple | None = None
    methods_not: tuple | None = None
    no_group: bool = False
    document: bool = False
    settles: str | None = None  # the open critical finding that the batch is about
    without_findings: tuple = ()


REVIEW, VISUAL, READY = ("state:NEEDS_REVIEW",), ("state:NEEDS_VISUAL_REVIEW",), ("READY_TO_SERVE",)
_SOURCES = ("upstream_effective", "admin", "original")
_LABELS = ("not_nfc_normalized", "option_label_normalized")
_PDF = ("pdf_text_layer_fidelity", *_LABELS)
_MAPPING = ("answer_mapping_ambiguous", "answer_from_highlight_only", "solution_link_ordinal_mismatch")
_GARBAGE = ("ocr_garbage", "raw_latex_in_text")
_WATERMARK, _LOW = "^as_watermark", "^low-resolution figure "
_PASSAGE, _PLACEHOLDER, _ANSWER = "group_passage_missing", "unresolved_placeholder", "answer_missing"
_FLAT = {"image": False, "table": False}
#: The batches in their order.
RULES = (
    Rule("normalization_only", reasons=REVIEW, flags_within=_LABELS, notes="none", subject_sources=_SOURCES),
    Rule("watermark_only", states=("NEEDS_VISUAL_REVIEW",), reasons=VISUAL, notes=_WATERMARK, subject_sources=_SOURCES),
    Rule("contamination_only", reasons=REVIEW, flags_within=_LABELS, notes="^possible segmentation contamination", subject_sources=_SOURCES),
    Rule("review_flags_minor", reasons=REVIEW, flags_within=("numbering_gap_in_section", *_LABELS), notes="none", methods=("docx_native", "doc->docx(libreoffice)"), no_group=True, **_FLAT),
    Rule("pdf_text_nonmath", reasons=REVIEW, flags_any=_PDF[:1], flags_within=_PDF, subjects=("geography", "english", "literature", "biology", "history", "civics"), without_findings=_GARBAGE),
    Rule("pdf_text_plain", reasons=REVIEW, flags_any=_PDF[:1], flags_within=_PDF, subjects=("math", "general", "physics", "chemistry"), without_findings=_GARBAGE),
    Rule("visual_lowres", states=("NEEDS_VISUAL_REVIEW",), reasons=VISUAL, notes=_LOW, notes_not=_WATERMARK),
    Rule("group_instruction_only", states=READY, reasons=("group_context_missing",), settles=_PASSAGE, **_FLAT),
    Rule("group_instruction_only_math", states=READY, reasons=("group_context_missing",), settles=_PASSAGE, formula=True, **_FLAT),
    Rule("group_instruction_only_numeric", states=READY, reasons=("group_context_missing",), settles=_PASSAGE, kind="numeric_response", formula=None, **_FLAT),
    Rule("group_detach_wrong_passage", states=READY, reasons=("group_membership_suspect",), formula=None, **_FLAT),
    Rule("render_warning_artifact", states=READY, reasons=("render_warning",), settles=_PLACEHOLDER, formula=None, **_FLAT),
    Rule("inline_options_split", states=READY, reasons=("inline_options_in_short_response",), kind="short_response", formula=None),
    Rule("dialogue_options_split", reasons=REVIEW, flags_within=_LABELS, notes="^possible segmentation contamination", subject_sources=_SOURCES),
    Rule("group_passage_recover", states=READY, reasons=("group_context_missing",), settles=_PASSAGE, document=True, **_FLAT),
    Rule("answer_linking", states=("NEEDS_ANSWER_LINKING",), settles=_ANSWER, methods_not=("pdf_text_layer",), **_FLAT),
    Rule("answer_linking_pdf", states=("NEEDS_ANSWER_LINKING", "NEEDS_REVIEW"), flags_within=(*_PDF, "missing_answer"), settles=_ANSWER, methods=("pdf_text_layer",), without_findings=_GARBAGE, **_FLAT),
    Rule("answer_ambiguous", reasons=REVIEW, flags_any=_MAPPING, flags_within=(*_MAPPING, *_LABELS), methods_not=("pdf_text_layer",), **_FLAT),
    Rule("answer_linking_formula", states=("NEEDS_ANSWER_LINKING",), settles=_ANSWER, methods_not=("pdf_text_layer",), formula=True, **_FLAT),
    Rule("answer_ambiguous_formula", reasons=REVIEW, flags_any=_MAPPING, flags_within=(*_MAPPING, *_LABELS), methods_not=("pdf_text_layer",), formula=True, **_FLAT),
    Rule("visual_watermark_shape", states=("NEEDS_VISUAL_REVIEW", "NEEDS_REVIEW"), flags_exact=("unsupported_object",), notes="^unsupported object drawing_shape$", methods_not=("pdf_text_layer",), **_FLAT),
    Rule("answer_ambiguous_pdf", reasons=REVIEW, flags_any=_MAPPING, flags_within=(*_MAPPING, *_PDF), methods=("pdf_text_layer",), without_findings=_GARBAGE, **_FLAT),
    Rule("visual_lowres_formula", states=("NEEDS_VISUAL_REVIEW",), reasons=VISUAL, notes=_LOW, notes_not=_WATERMARK, formula=True),
)
#: Batches by what their gates have besides the common ones.
SPLIT, DIALOGUE, RECOVER, DETACH = {"inline_options_split"}, {"dialogue_options_split"}, {"group_passage_recover"}, {"group_detach_wrong_passage"}
GROUP = {"group_instruction_only", "group_instruction_only_math", "group_instruction_only_numeric"}
ANSWERS = {"answer_linking", "answer_linking_pdf", "answer_ambiguous", "answer_linking_formula", "answer_ambiguous_formula", "answer_ambiguous_pdf"}
PLAIN = {"pdf_text_plain", "answer_linking_pdf", "answer_ambiguous_pdf"}
PDF_TEXT = PLAIN | {"pdf_text_nonmath"}
VISUALS = {"visual_lowres", "visual_lowres_formula"}


# ----------------------------------------------------------------------------------------------------- expressions
def _texts(values: tuple) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def fits(rule: Rule) -> Column:
    """Whether a question belongs to a batch, by the columns states, reasons, flags, notes, findings (structs of the code and
    severity of the open ones), kind, has_formula, has_image, has_table, subject, subject_source, method, group_key, document_id,
    removed, gate, draft (null, 'own' or 'other') and dirty."""
    c = F.col
    same = lambda name, values: F.array_sort(F.array_distinct(_list(name))) == F.array_sort(_texts(values))
    within = lambda name, values: F.size(F.array_except(_list(name), _texts(values))) == 0
    findings = F.coalesce(c("findings"), F.array().cast("array<struct<code:string,severity:string>>"))
    critical = F.exists(findings, lambda f: (f["severity"] == "critical") & (f["code"] != F.lit(rule.settles or "")))
    tests = [~_is(c("removed")), c("gate").isNull(), F.coalesce(c("draft") == "own", F.lit(True)), ~_is(c("dirty")), ~critical, same("states", rule.states), c("kind") == rule.kind]
    if rule.reasons is not None:
        tests.append(_list("reasons") == _texts(rule.reasons))
    if rule.flags_within is not None:
        tests.append(within("flags", rule.flags_within))
    if rule.flags_any is not None:
        tests.append(F.arrays_overlap(_list("flags"), _texts(rule.flags_any)))
    if rule.flags_exact is not None:
        tests.append(_list("flags") == _texts(rule.flags_exact))
    if rule.notes == "none":
        tests.append(F.size(_list("notes")) == 0)
    elif rule.notes is not None:
        tests += [F.forall(_list("notes"), lambda n: n.rlike(rule.notes))] + ([F.size(_list("notes")) > 0] if rule.notes_not is None and rule.notes != _WATERMARK else [])
    if rule.notes_not is not None:
        tests.append(F.exists(_list("notes"), lambda n: ~n.rlike(rule.notes_not)))
    tests += [_is(c(k)) == v for k, v in (("has_formula", rule.formula), ("has_image", rule.image), ("has_table", rule.table)) if v is not None]
    tests += [c(k).isin(*v) for k, v in (("subject_source", rule.subject_sources), ("subject", rule.subjects), ("method", rule.methods)) if v is not None]
    if rule.methods_not is not None:
        tests.append(~c("method").isin(*rule.methods_not))
    if rule.no_group:
        tests.append(c("group_key").isNull())
    if rule.document:
        tests.append(c("document_id").isNotNull())
    if rule.without_findings:
        tests.append(~F.exists(findings, lambda f: f["code"].isin(*rule.without_findings)))
    whole = tests[0]
    for t in tests[1:]:
        whole = whole & t
    return _is(whole)


def named_batches(questions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``questions`` once for each batch that they are in, with its name as ``batch``: one pass, whatever the number of rules."""
    names = F.array_compact(F.array(*[F.when(fits(r), F.lit(r.name)) for r in rules]))
    return questions.withColumn("batch", F.explode(names))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def structure_problem(kind: Column, options: Column, stem: Column) -> Column:
    """Why the options of a question are suspect, null where they are not: a choice has four, none with a list of its own."""
    held = lambda o, i: F.when(o.rlike(OPTION_LIST), F.concat(F.lit("option_with_list:"), i + 1)).when(o.rlike(LABEL_LINE), F.concat(F.lit("option_with_label_line:"), i + 1))
    first = F.get(F.filter(F.transform(options, lambda o, i: held(_text(o), i)), lambda x: x.isNotNull()), F.lit(0))
    n = F.coalesce(F.size(options), F.lit(0))
    numeric = F.when(n > 0, F.concat(F.lit("numeric_with_options:"), n)).when(_text(stem).rlike(OPTION_LIST), F.lit("numeric_stem_with_list"))
    return F.when(kind == "numeric_response", numeric).when(n != 4, F.concat(F.lit("option_count:"), n)).otherwise(first)


def incomplete(runs: Column, stem: Column, passage: Column, options: Column, has_visual: Column) -> Column:
    """Why a question lacks something that its text shows or names, null otherwise. ``runs`` are the stem's runs of text."""
    whole = F.concat(_text(stem), F.lit(" "), _text(passage))
    named = F.lower(F.regexp_extract(whole, FIGURE_HINT, 1))
    written = named.startswith(SCHEME) & F.concat(whole, F.lit(" "), F.array_join(options, " ")).rlike(ARROW)
    return F.when(F.exists(runs, lambda r: _text(r).rlike(LINE_GAP)), "gap_in_line").when((named != "") & ~_is(has_visual) & ~_is(written), F.concat(F.lit("refers_to:"), named))


def missing_exhibit(stem: Column, has_visual: Column) -> Column:
    named = F.lower(F.regexp_extract(_text(stem), EXHIBIT, 1))
    return F.when((named != "") & ~_is(has_visual), F.concat(F.lit("cites:"), named))


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(_text(text), r"[^\p{L}]+", ""))


def instruction_problem(header: Column, stem: Column, passage: Column, marked: Column) -> Column:
    """Why a group's header is more than an instruction, or a question of it does not stand alone; null where both do."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(_text(header), r"[0-9]+", " "), r"\s+", " "))
    refers = F.lower(F.regexp_extract(_text(stem), CONTEXT_REF, 1))
    blind = F.lower(plain).contains("has one error") & (F.coalesce(marked, F.lit(0)) < MARKED)
    return F.when(_text(passage) != "", "has_passage").when(~plain.rlike(GROUP_INSTRUCTION), "not_plain_instruction").when(_letters(stem) < ALONE, "stem_too_short").when(refers != "", F.concat(F.lit("refers_to:"), refers)).when(blind, "no_marked_parts")


def lost_passage(source: Column, header: Column, stem: Column, members: Column) -> Column:
    """Why a group's instruction may have lost its passage: text of the source between it and the group's first question.

    All are keys, ``header`` without digits, ``members`` the leads of the group's questions. Null where nothing is between them.
    """
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    lead, size = F.substring(_text(stem), 1, LEAD), F.length(header)

    def judge(at: Column) -> Column:
        above = F.substring(source, F.lit(1), at - 1)
        back = F.position(F.reverse(header), F.reverse(above))
        after = F.when(back > 0, F.length(above) - back + 2)  # the first place behind the last instruction above the question

        def gap(begin: Column) -> Column:
            nearer = lambda acc, m: let(F.position(F.substring(_text(m), 1, LEAD), source, begin), lambda k: F.when((F.length(F.substring(_text(m), 1, LEAD)) >= LEAST_LEAD) & (k > 0) & (k + F.length(F.substring(_text(m), 1, LEAD)) <= acc), k).otherwise(acc))
            first = F.aggregate(F.coalesce(members, F.array().cast("array<string>")), at, nearer)
            left = F.regexp_replace(F.regexp_replace(F.substring(source, begin, F.greatest(first - begin, F.lit(0))), "[0-9]+", ""), FILLER_WORDS, "")
            return F.when(F.length(left) > LEFT_OVER, F.concat(F.lit("text_between:"), F.length(left)))

        return F.when(after.isNull() | (at - (after - size) > INSTRUCTION_BACK), "instruction_not_found").otherwise(let(after, gap))

    found = F.position(lead, source)
    return F.when((F.length(lead) < LEAST_LEAD) | (found == 0) | (size < LEAST_LEAD), "not_located").otherwise(let(found, judge))


def passage_problem(passage: Column, stem: Column, passage_scores: Column, question_scores: Column) -> Column:
    """Why a question may not be taken from its passage, null where the two are clearly of different subjects.

    The scores are arrays of structs (subject, score) in one order; of equal scores the first counts.
    """
    best = lambda scores: F.aggregate(scores, F.get(scores, F.lit(0)), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    of = lambda scores, subject: F.coalesce(F.get(F.filter(scores, lambda x: x["subject"] == subject), F.lit(0))["score"], F.lit(0))
    p, q = best(passage_scores), best(question_scores)
    refers = F.lower(F.regexp_extract(_text(stem), CONTEXT_REF, 1))
    alike = (p["score"] < 1) | (q["score"] < 1) | (p["subject"] == q["subject"]) | (of(question_scores, p["subject"]) > 0) | (of(passage_scores, q["subject"]) > 0)
    return F.when(F.trim(_text(passage)) == "", "no_passage").when(refers != "", F.concat(F.lit("refers_to:"), refers)).when(_letters(stem) < APART, "stem_too_short").when(F.coalesce(alike, F.lit(True)), "subjects_alike")


def first_failing_gate(batch: Column, gates: list[tuple[set | None, Column]]) -> Column:
    """The reason of the first gate that fails: gates are (batches that have it, None for all, reason or null), in order."""
    return F.coalesce(*[reason if names is None else F.when(batch.isin(*sorted(names)), reason) for names, reason in gates], F.lit(None).cast("string"))


def gate_report(judged: DataFrame, batch: str = "batch", reason: str = "reason") -> DataFrame:
    """(batch, reason, n): how many of each batch are held by each kind of reason; 'promoted' for those that pass.

    A reason's kind is what stands before its colon.
    """
    kind = F.coalesce(F.substring_index(reason, ":", 1), F.lit("promoted"))
    return judged.groupBy(batch, kind.alias("reason")).agg(F.count("*").alias("n"))
