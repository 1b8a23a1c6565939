"""Validators of a question's working version: findings with code, severity and dimension, in a fixed order.

A question is a row of flat columns; rich text comes as its plain text, with formulas, images and placeholders in arrays of
their own. All checks are Spark expressions, but the test for NFC.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import nfc, odd_share

# Codes that do not block, marks of wrong encodings, raw formulas, next questions, headings, image paths.
WARNINGS = ["duplicate_option", "raw_latex_in_text", "ocr_garbage", "group_key_mismatch", "subject_missing", "ready_inconsistent", "solution_contains_next_question", "exact_duplicate", "near_duplicate", "upstream_changed"]
MOJIBAKE = "(Ã[\\x80-\\xbf¡-ÿ]|Â[\\x80-\\xbf ]|Ä[\\x80-\\xbf‘’]|áº|á»|Æ°|â€[™œ\\x9d“”])"
RAW_LATEX = r"(\\(frac|sqrt|left|right|int|sum|lim|alpha|beta|pi|Delta|cdot|times|le|ge|neq|vec|overline)\b|\$[^$\n]{1,80}\$|\^\{|_\{|\\\(|\\\[)"
NEXT_QUESTION = r"(?sU)(?:^|\n|\s)(?:Câu|Question)\s+\d{1,3}\s*[:.)]\s+\S.{10,}?(?:\n|\s)A[.)]\s"
HEADING = r"(?mU)\b(KIỂM TRA|ĐỀ THI|ĐỀ KIỂM TRA|PHẦN\s+[IVX]+\b|HẾT\s*-*$|-{3,}\s*HẾT)"
IMAGE_PATH = r"^[0-9a-f]{2}/[0-9a-f]{64}\.[a-z]{3,4}$"
SCATTERED = r"(?U)(?:\b\w\b\s){8,}"
NO_ANSWER_NEEDED = ["constructed_response", "open_or_unknown"]


def latex_problem(tex: Column) -> Column:
    """The first structural problem of a formula, null without one: braces, left and right, environments, a dollar sign."""
    plain = F.regexp_replace(tex, r"(?s)\\.", "")
    walk = F.aggregate(
        F.regexp_extract_all(plain, F.lit(r"([{}])"), 1),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda acc, ch: F.struct((acc["depth"] + F.when(ch == "{", 1).otherwise(-1)).alias("depth"), F.least(acc["low"], acc["depth"] + F.when(ch == "{", 1).otherwise(-1)).alias("low")),
    )
    sides = F.regexp_count(tex, F.lit(r"\\left(?![a-zA-Z])")) != F.regexp_count(tex, F.lit(r"\\right(?![a-zA-Z])"))
    marks = F.zip_with(F.regexp_extract_all(tex, F.lit(r"\\(begin|end)\{([a-zA-Z*]+)\}"), 1), F.regexp_extract_all(tex, F.lit(r"\\(begin|end)\{([a-zA-Z*]+)\}"), 2), lambda k, e: F.struct(k.alias("k"), e.alias("e")))
    empty = F.array().cast("array<string>")
    stack = F.aggregate(
        marks,
        F.struct(empty.alias("open"), F.lit(False).alias("bad")),
        lambda acc, m: F.when(acc["bad"], acc)
        .when(m["k"] == "begin", F.struct(F.concat(F.array(m["e"]), acc["open"]).alias("open"), F.lit(False).alias("bad")))
        .when(F.get(acc["open"], F.lit(0)).eqNullSafe(m["e"]), F.struct(F.slice(acc["open"], 2, F.size(acc["open"])).alias("open"), F.lit(False).alias("bad")))
        .otherwise(F.struct(acc["open"].alias("open"), F.lit(True).alias("bad"))),
    )
    return (
        F.when(walk["low"] < 0, "extra_brace")
        .when(walk["depth"] > 0, "open_brace")
        .when(sides, "left_right")
        .when(stack["bad"], "end_mismatch")
        .when(F.size(stack["open"]) > 0, "open_environment")
        .when(F.contains(F.replace(tex, F.lit("\\$"), F.lit("")), F.lit("$")), "dollar_inside")
    )


def ocr_suspect(text: Column) -> Column:
    """Why a text looks wrongly read or decoded, null where it does not."""
    long = F.length(text) >= 40
    beyond = F.when(~text.rlike(r"^[\x00-\x7f]*$"), text)  # ASCII text is NFC and does not go to Python
    return (
        F.when(F.coalesce(text, F.lit("")) == "", None)
        .when(F.contains(text, F.lit("\ufffd")), "replacement_character")
        .when(text.rlike(MOJIBAKE), "wrong_encoding")
        .when(nfc(beyond) != beyond, "not_nfc")
        .when(long & (odd_share(text) > 0.25), "odd_characters")
        .when(long & text.rlike(r"\p{L}") & text.rlike(SCATTERED), "scattered_letters")
    )


@dataclass(frozen=True)
class Question:
    """The columns of a question. Options are array<struct<label, text>>, the answer is an ``answers.ANSWER``."""

    external_id: Column
    in_bank: Column
    qtype: Column
    stem: Column
    stem_has_figure: Column
    options: Column
    input_kind: Column
    input_n: Column
    answer: Column
    images: Column
    known_images: Column
    n_placeholders: Column
    placeholder_in_formula: Column
    formulas: Column
    failing: Column
    group_key: Column
    group: Column  # struct<key, passage, instruction_only>
    subject: Column
    subject_source: Column
    state: Column
    states: Column
    reasons: Column
    solution: Column
    part_problems: Column
    missing_parts: Column


def _found(code: str, dimension: str, when: Column) -> Column:
    severity = "warning" if code in WARNINGS else "critical"
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(dimension).alias("dimension")))


def findings(q: Question) -> Column:
    """array<struct<code, severity, dimension>> of a question, each code once."""
    text = lambda c: F.coalesce(c, F.lit(""))
    labels, texts = F.transform(q.options, lambda o: o["label"]), F.transform(q.options, lambda o: text(o["text"]))
    n = F.size(q.options)
    expected = F.slice(F.array(*[F.lit(chr(65 + k)) for k in range(26)]), 1, F.greatest(n, F.lit(0)))
    keys = F.filter(F.transform(texts, lambda t: F.lower(F.regexp_replace(F.trim(t), r"(?U)\s+", " "))), lambda k: k != "")
    choice, kind = q.input_kind == "choice", q.answer["kind"]
    none = F.array().cast("array<string>")
    wanted = F.coalesce(q.answer["labels"], none)
    outside = F.size(F.array_except(wanted, labels)) > 0
    empty_key = (kind == "choice") & (outside | (F.size(wanted) == 0))
    malformed = (
        ((kind == "choice") & ~empty_key & (q.qtype == "single_choice") & (F.size(wanted) > 1))
        | ((kind == "tf_sequence") & ((F.size(F.coalesce(q.answer["values"], F.array().cast("array<boolean>"))) == 0) | (F.coalesce(q.input_n, F.lit(0)) > 0) & (q.input_n != F.size(q.answer["values"]))))
        | ((kind == "numeric") & (q.answer["value"].isNull() | F.isnan(q.answer["value"])))
        | ((kind == "text") & (F.trim(text(q.answer["text"])) == ""))
        | ~kind.isin("choice", "tf_sequence", "numeric", "text", "boolean", "parts")
    )
    images = F.coalesce(q.images, none)
    other = F.exists(F.coalesce(q.states, none), lambda s: s != "READY_TO_SERVE")
    blocking = F.exists(F.coalesce(q.reasons, none), lambda r: ~r.rlike("^(state|type|scoring):"))
    shown = F.array_join(F.concat(F.array(text(q.stem)), texts), "\n")
    formulas = F.coalesce(q.formulas, none)
    in_formula = F.coalesce(q.placeholder_in_formula, F.lit(False))
    return F.array_compact(
        F.array(
            _found("cq_id_format", "source", q.in_bank & q.external_id.startswith("cq_") & ~q.external_id.rlike("^cq_[0-9a-z_]+$")),
            _found("empty_stem", "content", (F.trim(text(q.stem)) == "") & ~q.stem_has_figure),
            _found("too_few_options", "content", choice & (n < 2)),
            _found("option_labels", "content", choice & (labels != expected)),
            _found("empty_option", "content", choice & F.exists(texts, lambda t: F.trim(t) == "")),
            _found("duplicate_option", "content", choice & (F.size(F.array_distinct(keys)) < F.size(keys))),
            _found("answer_missing", "answer", (q.answer.isNull() & ~q.qtype.isin(NO_ANSWER_NEEDED)) | ((kind == "parts") & (F.size(F.coalesce(q.missing_parts, none)) > 0))),
            _found("answer_not_in_options", "answer", empty_key),
            _found("answer_malformed", "answer", q.answer.isNotNull() & malformed),
            _found("parts_malformed", "content", (q.qtype == "multi_part") & (F.size(F.coalesce(q.part_problems, none)) > 0)),
            _found("broken_image_ref", "visual", F.exists(images, lambda i: ~i.rlike(IMAGE_PATH))),
            _found("missing_asset", "visual", F.exists(images, lambda i: i.rlike(IMAGE_PATH) & ~F.array_contains(F.coalesce(q.known_images, none), i))),
            _found("unresolved_placeholder", "formula", (q.n_placeholders > 0) & in_formula),
            _found("unresolved_placeholder", "visual", (q.n_placeholders > 0) & ~in_formula),
            _found("malformed_latex", "formula", F.exists(formulas, lambda f: latex_problem(f).isNotNull())),
            _found("formula_render_error", "formula", F.size(F.array_intersect(F.transform(formulas, lambda f: F.sha2(f, 256)), F.coalesce(q.failing, none))) > 0),
            _found("raw_latex_in_text", "formula", F.concat(shown, F.lit("\n"), text(q.solution)).rlike(RAW_LATEX)),
            _found("ocr_garbage", "content", ocr_suspect(shown).isNotNull()),
            _found("group_key_mismatch", "content", q.group_key.isNotNull() & (q.group.isNull() | (q.group["key"] != q.group_key))),
            _found("group_passage_missing", "content", q.group.isNotNull() & (F.trim(text(q.group["passage"])) == "") & ~F.coalesce(q.group["instruction_only"], F.lit(False))),
            _found("subject_missing", "subject", (text(q.subject) == "") | (q.subject_source == "unclassified")),
            _found("ready_inconsistent", "general", (q.state == "READY_TO_SERVE") & (other | blocking)),
            _found("solution_contains_next_question", "content", text(q.solution).rlike(NEXT_QUESTION) | text(q.solution).rlike(HEADING)),
        )
    )
