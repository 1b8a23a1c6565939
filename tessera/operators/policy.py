"""Serving policy, subject resolution, review queues: reason arrays from column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    allowed_states: tuple[str, ...] = ("READY_TO_SERVE",)
    allowed_types: tuple[str, ...] = ("single_choice", "multiple_choice", "numeric_response")
    blocking: tuple[str, ...] = field(default_factory=tuple)
    allow_self_check: bool = True

    def merged(self, stored: dict | None) -> Policy:
        """Stored settings over the defaults; unknown keys are dropped."""
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in (stored or {}).items() if k in self.__dataclass_fields__})


def reasons(policy: Policy, state: Column, kind: Column, flags: Column, removed: Column, scoring: Column, gate: Column, bank_active: Column | None = None) -> Column:
    """Why a record is not served, in the fixed order state, review, type, content flags, removal, scoring, bank.

    An approval stands in for the ready state; the label still names the record's own state.
    """
    effective = F.when(gate == "ready", "READY_TO_SERVE").otherwise(state)
    head = F.array(
        F.when(~effective.isin(*policy.allowed_states), F.concat(F.lit("state:"), state)),
        F.when(gate == "blocked", F.lit("review:blocked")),
        F.when(~kind.isin(*policy.allowed_types), F.concat(F.lit("type:"), kind)),
    )
    content = F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda r: r.isin(*policy.blocking) if policy.blocking else F.lit(False))
    tail = F.array(
        F.when(removed, F.lit("removed_upstream")),
        F.when(scoring == "none", F.lit("scoring:none")).when((scoring == "self_check") & F.lit(not policy.allow_self_check), F.lit("scoring:self_check")),
        F.when(~bank_active, F.lit("bank_inactive")) if bank_active is not None else F.lit(None).cast("string"),
    )
    return F.array_compact(F.concat(head, content, tail))


def served(eligible: Column, override: Column) -> Column:
    return F.when(override == "enable", True).when(override == "disable", False).otherwise(eligible)


def first_by_priority(states: Column, priority: list[str]) -> Column:
    """The states that are present, in priority order."""
    return F.array_intersect(F.array(*map(F.lit, priority)), states)


def resolve_subject(override: Column, upstream: Column, has_upstream: Column, original: Column, inferred: Column, confidence: Column, alias: Column, generic: list[str], accepted: list[str]) -> Column:
    """struct<code, source> by precedence: override, upstream's classification, original, inferred, original again, fallback.

    ``alias`` maps source values to codes; the empty value names the fallback. An upstream code without an alias switches
    the inference off.
    """
    get = lambda k: F.try_element_at(alias, k)
    fallback = get(F.lit(""))
    key = F.coalesce(original, F.lit(""))
    made = lambda code, source: F.struct(code.alias("code"), F.lit(source).alias("source"))
    return (
        F.when(override.isNotNull(), made(override, "admin"))
        .when(has_upstream & upstream.isNull(), made(fallback, "unclassified"))
        .when(has_upstream & get(upstream).isNotNull(), made(get(upstream), "upstream_effective"))
        .when(~key.isin(*generic) & get(key).isNotNull(), made(get(key), "original"))
        .when(~has_upstream & get(inferred).isNotNull() & confidence.isin(*accepted), made(get(inferred), "inferred"))
        .when((key != "") & get(key).isNotNull() & ~get(key).eqNullSafe(fallback), made(get(key), "original"))
        .otherwise(made(fallback, "unclassified"))
    )


def dimension_status(recorded: Column, recorded_hash: Column, current_hash: Column, required: Column) -> Column:
    """ok, fail ... while the hash stands; stale after a change; pending or na without a decision."""
    return F.when(recorded.isNotNull() & recorded_hash.eqNullSafe(current_hash), recorded).when(recorded.isNotNull(), "stale").when(required, "pending").otherwise("na")


def review_gate(statuses: Column, approved: Column, draft: Column, critical: Column, was_ready: Column) -> Column:
    done = F.forall(statuses, lambda s: s.isin("ok", "na"))
    return F.when(F.array_contains(statuses, "fail"), "blocked").when(approved & ~draft & done & (critical == 0), "ready").when(draft & was_ready, "ready")


def queues(**rules: Column) -> Column:
    """Names of the queues whose rule holds, in the order given."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def priority_score(blockers: Column, has_answer: Column, classified: Column, served_with_findings: Column, draft: Column, critical: Column) -> Column:
    add = lambda cond, n: F.when(cond, n).otherwise(0)
    return add(blockers == 1, 40) + add(has_answer, 20) + add(classified, 10) + add(served_with_findings, 30) + add(draft, 15) - F.least(critical, F.lit(3)) * 5


def serves_bank(pool_banks: Column, item_banks: Column, bank: Column) -> Column:
    """Whether a blueprint can draw from a bank: a pool names it or names none, or a fixed item is its own.

    ``pool_banks``: array<array<string>>, an empty or null one names none; ``item_banks``: array<string>.
    """
    open_pool = F.exists(pool_banks, lambda b: F.coalesce(F.size(b) <= 0, F.lit(True)) | F.coalesce(F.array_contains(b, bank), F.lit(False)))
    return F.coalesce(open_pool, F.lit(False)) | F.coalesce(F.array_contains(item_banks, bank), F.lit(False))


# Editorial states, the gravest first; flags of broken text, flags a rebuilt stem settles, flags that need no review.
STATES = ["REJECTED", "NEEDS_FORMULA_REVIEW", "NEEDS_VISUAL_REVIEW", "NEEDS_ANSWER_LINKING", "NEEDS_REVIEW", "READY_TO_SERVE"]
BROKEN_TEXT = ["legacy_encoding_mojibake", "encoding_replacement_char"]
SETTLED = ["pdf_text_layer_fidelity", "formula_low_confidence", "formula_unconverted"]
HARMLESS = ["missing_solution", "image_dependent", "missing_answer"]
UNANSWERED = ["UNRESOLVED", "AUTOMATICALLY_INFERRED_CANDIDATE"]


def editorial_states(review: Column, issues: Column, flags: Column, answer_source: Column, from_text_layer: Column, mathematical: Column, needs_figure: Column, rebuilt: Column) -> Column:
    """A record's editorial states, the gravest first; READY_TO_SERVE alone where nothing is open.

    ``issues`` are the kinds of what went wrong in rendering. Text from a page's text layer may have lost formulas
    (``mathematical``) or figures (``needs_figure``) unless its stem was ``rebuilt``.
    """
    none = F.array().cast("array<string>")
    issues, flags = F.coalesce(issues, none), F.coalesce(flags, none)
    any_of = lambda have, names: F.size(F.array_intersect(have, F.array(*map(F.lit, names)))) > 0
    layer = from_text_layer & ~rebuilt
    harmless = F.array(*map(F.lit, HARMLESS))
    left = F.array_except(flags, F.when(rebuilt, F.array(*map(F.lit, HARMLESS + SETTLED))).otherwise(harmless))
    rules = {
        "REJECTED": review == "rejected",
        "NEEDS_FORMULA_REVIEW": any_of(issues, ["formula"]) | (layer & mathematical),
        "NEEDS_VISUAL_REVIEW": any_of(issues, ["visual", "missing_visual"]) | (layer & needs_figure),
        "NEEDS_ANSWER_LINKING": answer_source.isNull() | answer_source.isin(UNANSWERED),
        "NEEDS_REVIEW": any_of(issues, ["content"]) | any_of(flags, BROKEN_TEXT) | ((review == "needs_review") & (F.size(left) > 0)),
    }
    open_ = queues(**{k: F.coalesce(v, F.lit(False)) for k, v in rules.items()})
    return F.when(F.size(open_) > 0, open_).otherwise(F.array(F.lit(STATES[-1])))
