"""Answers: what a source gives as a key, normalised into one tagged struct; input specification, scoring mode, responses.

``ANSWER`` has the fields of all kinds: "choice" (labels), "numeric" (value, text, unit), "text" (text), "boolean" (flag) and
"tf_sequence" (values). A raw answer is a struct with ``kind``, ``labels``, ``value``, ``text``, ``unit`` and ``values``
(strings). All is Spark expressions but the NFC step of ``norm_text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import nfc, nfc_each, parse_number, round_even, settle
from tessera.operators import scoring

ANSWER = "struct<kind: string, labels: array<string>, value: double, text: string, unit: string, values: array<boolean>, flag: boolean>"
RESULT = f"struct<answer: {ANSWER}, problem: string>"

# Sources whose keys count, kinds of questions, words for true and false, forms of keys, references between options.
TRUSTED_SOURCES = ["SOURCE_PROVIDED_ANSWER", "SOURCE_PROVIDED_SOLUTION", "EDITORIAL_TRANSCRIBED", "IMPORTED"]
CHOICE_TYPES = ["single_choice", "multiple_choice", "error_identification"]
TRUE_WORDS = ["đúng", "d", "đ", "true", "t", "yes", "có"]
FALSE_WORDS = ["sai", "s", "false", "f", "no", "không"]
NUMBER_FORM = r"^[+\-−]?\d+(?:[.,]\d+)?$"
STATEMENT_FORM = r"(?U)[a-h]\)?\s*[-:]?\s*(đúng|sai|đ|s)\b"
LETTER_FORM = r"^\s*[A-Da-d]\s*[.)]?\s*$"
OPTION_REFERENCE = (
    r"(?iuU)(?:\b(?:cả|câu|đáp án|phương án|ý|both|all|none|only)\s+[A-H]\b)|\b[A-H]\s*(?:và|,|and|&|hoặc|or)\s*[A-H]\b"
    r"|tất cả|các (?:đáp án|phương án|ý) trên|cả \w+ (?:đáp án|phương án|ý)|đều (?:đúng|sai)"
    r"|không có (?:đáp án|phương án)|all of the above|none of the above|both .* and"
)

_NONE = {"labels": "array<string>", "value": "double", "text": "string", "unit": "string", "values": "array<boolean>", "flag": "boolean"}


def answer_of(kind: str, **fields: Column) -> Column:
    """A struct of type ``ANSWER`` with the named fields."""
    rest = [fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in _NONE.items()]
    return F.struct(F.lit(kind).alias("kind"), *rest).cast(ANSWER)


def _good(answer: Column) -> Column:
    return F.struct(answer.alias("answer"), F.lit(None).cast("string").alias("problem")).cast(RESULT)


def _bad(problem: str) -> Column:
    return F.struct(F.lit(None).cast(ANSWER).alias("answer"), F.lit(problem).alias("problem")).cast(RESULT)


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _word_flag(w: Column) -> Column:
    """True or false for a normalised word, null for any other."""
    return F.when(w.isin(TRUE_WORDS), True).when(w.isin(FALSE_WORDS), False)


def _normalized(qtype: Column, raw: Column, source: Column, option_labels: Column, nfc_text: Column, nfc_values: Column, nfc_options: Column) -> Column:
    labels = F.array_sort(F.array_distinct(F.array_compact(_strings(raw["labels"]))))
    options = _strings(option_labels)
    from_labels = (
        F.when(F.size(labels) == 0, _bad("answer_empty"))
        .when(F.size(options) == 0, _bad("answer_without_options"))
        .when(F.size(F.array_except(labels, options)) > 0, _bad("answer_not_in_options"))
        .otherwise(_good(answer_of("choice", labels=labels)))
    )
    normed = settle(nfc_text)
    number = F.coalesce(raw["value"], parse_number(normed))
    unit = F.when(qtype != "true_false_statements", raw["unit"])
    written = F.coalesce(F.nullif(raw["text"], F.lit("")), number.cast("string"))
    from_number = F.when(number.isNull(), _bad("answer_unparseable")).otherwise(_good(answer_of("numeric", value=number, text=written, unit=unit)))
    flags = F.transform(nfc_values, lambda v: _word_flag(settle(v)))
    from_sequence = F.when(F.size(flags) == 0, _bad("answer_empty")).when(F.exists(flags, lambda f: f.isNull()), _bad("answer_unparseable")).otherwise(_good(answer_of("tf_sequence", values=flags)))

    text = F.trim(F.regexp_replace(F.coalesce(raw["text"], F.lit("")), r"(?U)^\s+|\s+$", ""))
    letter = F.upper(F.regexp_replace(text, r"\.+$", ""))
    same = F.filter(F.zip_with(options, nfc_options, lambda label, t: F.when(settle(t) == normed, label)), lambda label: label.isNotNull())
    from_option = (
        F.when(F.array_contains(options, letter), _good(answer_of("choice", labels=F.array(letter))))
        .when(F.size(same) == 1, _good(answer_of("choice", labels=F.slice(same, 1, 1))))
        .otherwise(_bad("answer_not_in_options"))
    )
    flag = _word_flag(normed)
    statements = F.transform(F.regexp_extract_all(normed, F.lit(STATEMENT_FORM), 1), lambda w: w.isin("đúng", "đ"))
    parsed = parse_number(normed)
    from_text = (
        F.when(text == "", _bad("answer_empty"))
        .when(F.size(options) > 0, from_option)
        .when((qtype == "true_false") & flag.isNotNull(), _good(answer_of("boolean", flag=flag)))
        .when(qtype == "true_false", _bad("answer_unparseable"))
        .when((qtype == "true_false_statements") & (F.size(statements) > 0), _good(answer_of("tf_sequence", values=statements)))
        .when(qtype == "true_false_statements", _bad("answer_unparseable"))
        .when(parsed.isNotNull() & F.replace(normed, F.lit(" "), F.lit("")).rlike(NUMBER_FORM), _good(answer_of("numeric", value=parsed, text=text, unit=raw["unit"])))
        .otherwise(_good(answer_of("text", text=text)))
    )
    none = F.struct(F.lit(None).cast(ANSWER).alias("answer"), F.lit(None).cast("string").alias("problem")).cast(RESULT)
    return (
        F.when(raw.isNull() | ~F.coalesce(source, F.lit("")).isin(TRUSTED_SOURCES), none)
        .when(raw["kind"] == "labels", from_labels)
        .when(raw["kind"] == "numeric", from_number)
        .when(raw["kind"] == "true_false_sequence", from_sequence)
        .when(raw["kind"] == "text", from_text)
        .otherwise(_bad("answer_kind_unknown"))
    )


def with_answer(df: DataFrame, qtype: Column, raw: Column, source: Column, option_labels: Column, option_texts: Column) -> DataFrame:
    """``df`` with ``answer``, the provided key as an ``ANSWER``, and ``problem``, why it cannot be used; both null without one.

    ``option_labels`` and ``option_texts`` are parallel arrays.
    """
    normal = F.struct(nfc(F.coalesce(raw["text"], F.lit(""))).alias("text"), nfc_each(raw["values"]).alias("values"), nfc_each(option_texts).alias("options"))
    df = df.withColumn("_nfc", normal)
    made = _normalized(qtype, raw, source, option_labels, F.col("_nfc.text"), F.col("_nfc.values"), F.col("_nfc.options"))
    return df.withColumn("_made", made).select("*", F.col("_made.answer").alias("answer"), F.col("_made.problem").alias("problem")).drop("_nfc", "_made")


def input_spec(qtype: Column, n_options: Column, answer: Column, statements: Column) -> Column:
    """struct<kind, multi, n>: what is entered. ``statements`` is the number of labelled statements in the stem."""
    made = lambda kind, multi=None, n=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if multi is None else multi).cast("boolean").alias("multi"), (F.lit(None) if n is None else n).cast("int").alias("n"))
    kind, several = answer["kind"], qtype == "multiple_choice"
    choosing = qtype.isin(CHOICE_TYPES) | ((qtype == "true_false") & (n_options > 0))
    return (
        F.when(kind == "choice", made("choice", several | (F.size(answer["labels"]) > 1)))
        .when(choosing & (n_options > 0), made("choice", several))
        .when(choosing, made("none"))
        .when(kind == "tf_sequence", made("tf_sequence", n=F.size(answer["values"])))
        .when(kind == "numeric", made("numeric"))
        .when((qtype == "true_false_statements") & (statements > 0), made("tf_sequence", n=statements))
        .when(qtype == "true_false", made("boolean"))
        .when(qtype == "numeric_response", made("numeric"))
        .when(qtype == "short_response", made("text"))
        .otherwise(made("none"))
    )


def scoring_mode(input_kind: Column, answer: Column, has_solution: Column, text_auto: bool = False) -> Column:
    """auto, self_check (compare with the key or the solution) or none (nothing to compare with)."""
    by_eye = (input_kind == "none") if text_auto else (answer["kind"] == "text") | (input_kind == "none")
    return F.when(answer.isNotNull(), F.when(by_eye, "self_check").otherwise("auto")).when(has_solution, "self_check").otherwise("none")


def letter_key_without_options(n_options: Column, answer: Column) -> Column:
    """A key that is a lone option letter on a question without options."""
    return F.coalesce((answer["kind"] == "text") & (n_options == 0) & answer["text"].rlike(LETTER_FORM), F.lit(False))


def option_count_suspect(qtype: Column, n_options: Column) -> Column:
    """A single-choice question with options, but not four."""
    return (qtype == "single_choice") & (n_options > 0) & (n_options != 4)


def shuffle_safe(qtype: Column, option_texts: Column) -> Column:
    """Options may change places: two or more, and none refers to others or to its place."""
    texts = _strings(option_texts)
    return (qtype != "error_identification") & (F.size(texts) >= 2) & ~F.exists(texts, lambda t: F.coalesce(t, F.lit("")).rlike(OPTION_REFERENCE))


def fraction(answer: Column, labels: Column, value: Column, text: Column, values: Column, flag: Column, tolerance: float = 1e-6, partial: bool = False, rule: str = "all_or_nothing") -> Column:
    """How much of a response of the answer's own kind is right, from 0 to 1."""
    wanted = F.size(answer["values"])
    given = F.slice(F.concat(F.coalesce(values, F.array().cast("array<boolean>")), F.array_repeat(F.lit(None).cast("boolean"), wanted)), 1, F.greatest(wanted, F.lit(1)))
    return (
        F.when(answer["kind"] == "choice", scoring.choice_fraction(answer["labels"], labels, partial))
        .when(answer["kind"] == "numeric", F.coalesce(scoring.numeric_fraction(answer["value"], value, tolerance), F.lit(0.0)))
        .when(answer["kind"] == "boolean", F.when(flag == answer["flag"], 1.0).otherwise(0.0))
        .when(answer["kind"] == "tf_sequence", scoring.statements_fraction(answer["values"], given, rule))
        .when(answer["kind"] == "text", F.when(settle(F.coalesce(text, F.lit(""))) == settle(answer["text"]), 1.0).otherwise(0.0))
        .otherwise(0.0)
    )


def part_outcomes(parts: Column) -> Column:
    """Outcome, fraction and award of each part of array<struct<key, points, graded, blank, fraction>>.

    A part without a key is ungraded, a blank one unanswered; both are awarded nothing.
    """

    def one(p: Column) -> Column:
        weight = F.coalesce(F.nullif(p["points"], F.lit(0.0)), F.lit(1.0))
        counts = p["graded"] & ~p["blank"]
        share = F.when(counts, p["fraction"]).otherwise(0.0)
        outcome = F.when(~p["graded"], "ungraded").when(p["blank"], "unanswered").when(share >= 1, "correct").when(share > 0, "partial").otherwise("incorrect")
        return F.struct(p["key"].alias("key"), outcome.alias("outcome"), share.alias("fraction"), weight.alias("points"), round_even(share * weight, 6).alias("awarded"))

    return F.transform(parts, one)


def parts_fraction(outcomes: Column) -> Column:
    """Share of the points of the graded parts that were awarded; 0 without any."""
    graded = F.filter(outcomes, lambda p: p["outcome"] != "ungraded")
    total = lambda field: F.aggregate(graded, F.lit(0.0), lambda acc, p: acc + p[field])
    return F.when(total("points") > 0, total("awarded") / total("points")).otherwise(0.0)


def missing_answers(keys: Column, answered: Column) -> Column:
    """Keys of the parts without an answer, in their order."""
    return F.filter(keys, lambda k: ~F.coalesce(F.array_contains(_strings(answered), k), F.lit(False)))


def part_problems(parts: Column, keys: Column) -> Column:
    """Codes of what is wrong with array<struct<key, prompt, answer_type, options: array<string>>>, in a fixed order."""
    known = ["choice", "numeric", "text", "formula", "boolean"]
    code = lambda p, name: F.concat(F.lit(name + ":"), F.coalesce(p["key"], F.lit("")))
    each = F.flatten(
        F.transform(
            parts,
            lambda p: F.array_compact(
                F.array(
                    F.when(F.trim(F.coalesce(p["prompt"], F.lit(""))) == "", code(p, "prompt_missing")),
                    F.when(~F.coalesce(p["answer_type"].isin(known), F.lit(False)), code(p, "answer_type_unknown")),
                    F.when((p["answer_type"] == "choice") & (F.size(_strings(p["options"])) < 2), code(p, "too_few_options")),
                    F.when((p["answer_type"] == "choice") & F.exists(_strings(p["options"]), lambda o: F.trim(F.coalesce(o, F.lit(""))) == ""), code(p, "empty_option")),
                )
            ),
        )
    )
    whole = F.array_compact(F.array(F.when(F.size(parts) < 1, F.lit("no_parts")), F.when(F.size(F.array_distinct(keys)) != F.size(keys), F.lit("duplicate_keys"))))
    return F.concat(whole, each)


def incompatible(answer: Column, input_kind: Column, multi: Column, n: Column, option_labels: Column) -> Column:
    """Why a stored answer cannot be scored against its question's input, null where it can."""
    kind = answer["kind"]
    labels = _strings(answer["labels"])
    outside = (F.size(labels) == 0) | (F.size(F.array_except(labels, _strings(option_labels))) > 0)
    number = answer["value"].isNotNull() & ~F.isnan(answer["value"]) & input_kind.isin("numeric", "text")
    sequence = (input_kind == "tf_sequence") & (n == F.size(F.coalesce(answer["values"], F.array().cast("array<boolean>"))))
    wrong = lambda fine, reason: F.when(~F.coalesce(fine, F.lit(False)), reason)
    return (
        F.when(kind.isNull(), "no_answer")
        .when(kind == "choice", F.when(input_kind != "choice", "choice_answer_without_choice_input").when(outside, "labels_not_in_options").when(~F.coalesce(multi, F.lit(False)) & (F.size(labels) > 1), "multiple_labels_single_choice"))
        .when(kind == "numeric", wrong(number, "numeric_answer_invalid"))
        .when(kind == "tf_sequence", wrong(sequence, "tf_sequence_length_mismatch"))
        .when(kind == "boolean", wrong(answer["flag"].isNotNull(), "boolean_invalid"))
        .when(kind == "text", wrong(F.trim(answer["text"]) != "", "text_empty"))
        .otherwise("unknown_answer_kind")
    )


RESPONSE = "struct<labels: array<string>, value: string, text: string, values: array<boolean>, flag: boolean>"
#: Characters kept of a response's text by kind of input.
KEPT = {"text": 2000, "math": 400, "none": 5000}


def read_response(raw: Column, input_kind: Column, multi: Column, n: Column, option_labels: Column) -> Column:
    """struct<response, error> of a response in JSON: cleaned for its kind of input, or why it is refused; both null for none."""
    got = F.from_json(raw, RESPONSE)
    broken = F.get_json_object(raw, "$").isNull() | ~raw.rlike(r"^\s*\{")
    labels = F.array_sort(F.array_distinct(_strings(got["labels"])))
    has = lambda name: F.get_json_object(raw, f"$.{name}").isNotNull()
    none = {"labels": "array<string>", "value": "string", "text": "string", "values": "array<boolean>", "flag": "boolean"}
    clean = lambda **x: F.struct(*[x.get(k, F.lit(None)).cast(t).alias(k) for k, t in none.items()]).cast(RESPONSE)
    out = f"struct<response: {RESPONSE}, error: string>"
    good = lambda r: F.struct(r.alias("response"), F.lit(None).cast("string").alias("error")).cast(out)
    bad = lambda e: F.struct(F.lit(None).cast(RESPONSE).alias("response"), F.lit(e).alias("error")).cast(out)
    text = lambda kind: good(clean(text=F.substring(F.coalesce(got["text"], F.lit("")), 1, KEPT[kind])))
    choice = (
        F.when(~has("labels"), bad("malformed"))
        .when(F.size(F.array_except(labels, _strings(option_labels))) > 0, bad("no_such_option"))
        .when(~F.coalesce(multi, F.lit(False)) & (F.size(labels) > 1), bad("one_option_only"))
        .otherwise(good(clean(labels=labels)))
    )
    sequence = F.when(~has("values") | (F.size(got["values"]) > F.coalesce(n, F.lit(0))), bad("malformed")).otherwise(good(clean(values=got["values"])))
    nothing = F.struct(F.lit(None).cast(RESPONSE).alias("response"), F.lit(None).cast("string").alias("error")).cast(out)
    return (
        F.when(raw.isNull(), nothing)
        .when(broken, bad("malformed"))
        .when(input_kind == "choice", choice)
        .when(input_kind == "numeric", good(clean(value=F.substring(got["value"], 1, 60))))
        .when(input_kind == "text", text("text"))
        .when(input_kind.isin("math", "formula"), text("math"))
        .when(input_kind == "tf_sequence", sequence)
        .when(input_kind == "boolean", good(clean(flag=got["flag"])))
        .when(input_kind == "none", F.when(has("text"), text("none")).otherwise(nothing))
        .otherwise(bad("no_response_expected"))
    )
