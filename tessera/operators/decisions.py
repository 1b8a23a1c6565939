"""Decision files: reviewers' actions on records, folded in order, stale ones rejected, each applied once.

A decision names its record, the version of it that the reviewer saw, and any of the actions of ``ACTIONS``, which are tried in that
order. It is applied whole or not at all. What happened to each is its outcome: ``missing`` (no such record), ``done`` (in the
log already), ``stale`` (the content changed after the reviewer saw it), ``refused`` (an action did not fit), or the names of
the actions that changed something, ``nothing`` where none did.

Odd input: null flags and arguments are no action; a null seen version is stale; decisions of one record are ordered by
``seq``, then id; a record's decisions, as many as one file has for it, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The actions in the order in which a decision's are applied.
ACTIONS = ("reverted", "subject_cleared", "group_detached", "furniture_cleaned", "text_fixed", "answer_fixed", "subject_fixed", "visual_confirmed", "visual_failed", "subject_confirmed")
#: So many decisions, and so many runs of them, are folded to one log: what a fold carries is copied at each of its steps.
RUN = 32
STATE = ("version", "text", "subject", "answer", "grp", "visual", "subject_ok")
ASKED = ("revert", "clear_subject", "detach_group", "clean", "old", "new", "new_answer", "new_subject", "confirm_visual", "visual_fail", "confirm_subject")


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text, without overlaps; null for an empty part."""
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.nullif(F.length(part), F.lit(0))


def _apply(s: Column, d: Column, furniture: str) -> Column:
    """struct<state, outcome> after one decision ``d`` on a state ``s``."""
    yes = lambda k: F.coalesce(d[k], F.lit(False))
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  names a value that is used several times
    stale = F.coalesce(d["seen"] < s["version"], F.lit(True))
    fix = d["old"].isNotNull()
    cleaned = F.when(yes("clean"), F.regexp_replace(s["text"], furniture, "")).otherwise(s["text"])

    def changed(text: Column) -> Column:
        unfit = (yes("clean") & (text == s["text"])) | (fix & F.coalesce(occurrences(text, d["old"]) != 1, F.lit(True)))
        fixed = F.when(fix, F.replace(text, d["old"], F.coalesce(d["new"], F.lit("")))).otherwise(text)
        cut = yes("detach_group") & s["grp"].isNotNull()
        subject = F.when(d["new_subject"].isNotNull(), d["new_subject"]).when(yes("clear_subject"), F.lit(None)).otherwise(s["subject"])
        moved = F.coalesce(d["new_subject"] != F.coalesce(F.when(~yes("clear_subject"), s["subject"]), F.lit("")), F.lit(False))
        edits = [yes("clear_subject") & s["subject"].isNotNull(), cut, yes("clean"), fix, d["new_answer"].isNotNull(), moved, yes("confirm_visual"), yes("visual_fail"), d["new_subject"].isNotNull() | yes("confirm_subject")]
        names = F.concat_ws(",", *[F.when(e, F.lit(n)) for e, n in zip(edits, ACTIONS[1:], strict=True)])
        bump = (cut | yes("clean") | fix | d["new_answer"].isNotNull()).cast("long")
        visual = F.when(yes("visual_fail"), "fail").when(yes("confirm_visual"), "ok").when(bump > 0, F.lit(None).cast("string")).otherwise(s["visual"])
        after = F.struct((s["version"] + bump).alias("version"), fixed.alias("text"), subject.alias("subject"), F.coalesce(d["new_answer"], s["answer"]).alias("answer"), F.when(~yes("detach_group"), s["grp"]).alias("grp"), visual.alias("visual"), (d["new_subject"].isNotNull() | yes("confirm_subject") | (s["subject_ok"] & ~yes("clear_subject"))).alias("subject_ok"))
        return F.when(unfit, F.struct(s.alias("state"), F.lit("refused").alias("outcome"))).otherwise(F.struct(after.alias("state"), F.when(names == "", F.lit("nothing")).otherwise(names).alias("outcome")))

    back = F.struct((s["version"] + 1).alias("version"), d["published"].alias("text"), s["subject"].alias("subject"), s["answer"].alias("answer"), s["grp"].alias("grp"), F.lit(None).cast("string").alias("visual"), s["subject_ok"].alias("subject_ok"))
    return F.when(stale, F.struct(s.alias("state"), F.lit("stale").alias("outcome"))).when(yes("revert"), F.struct(back.alias("state"), F.lit("reverted").alias("outcome"))).otherwise(let(cleaned, changed))


def apply_decisions(records: DataFrame, decisions: DataFrame, key: str, furniture: str, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``records`` after the decisions, and the outcomes (decision_id, key, outcome) of all of them.

    ``records`` has the columns of ``STATE`` and ``published``, the text that a revert restores (without it, the one they come with); ``decisions`` has decision_id, seq, seen
    and the columns of ``ASKED``. ``done`` is the log of outcomes of earlier runs: what it names is not applied again, so that a
    file that is applied twice has the effect of one run.
    """
    log = (done.where("outcome not in ('missing', 'stale', 'refused', 'done')").select("decision_id").distinct() if done is not None else decisions.select("decision_id").where("false")).withColumn("_known", F.lit(True))
    asked = decisions.join(log, "decision_id", "left")
    fresh = asked.where("_known is null")
    lists = fresh.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "decision_id", "seen", *ASKED))).alias("_ds"))
    none = F.array().cast("array<struct<decision_id:bigint,outcome:string>>")
    begin = lambda state: F.struct(state.alias("state"), none.alias("log"))

    def step(acc: Column, d: Column) -> Column:
        told = _apply(acc["state"], d.withField("published", F.col("published")), furniture)
        return F.get(F.transform(F.array(told), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["log"], F.struct(d["decision_id"].alias("decision_id"), r["outcome"].alias("outcome"))).alias("log"))), F.lit(0))

    def over_runs(ds: Column, state: Column, sizes: tuple[int, ...]) -> Column:
        """The fold of ``ds`` by runs of the first size, these by runs of the next one, at last decision by decision."""
        if not sizes:
            return F.aggregate(ds, begin(state), step)
        n = sizes[0]
        runs = F.transform(F.sequence(F.lit(1), F.size(ds), F.lit(n)), lambda i: F.slice(ds, i, F.lit(n)))
        some = F.when(F.size(ds) > 0, runs).otherwise(F.array().cast(f"array<{kind}>"))

        def join(acc: Column, run: Column) -> Column:
            return F.get(F.transform(F.array(over_runs(run, acc["state"], sizes[1:])), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["log"], r["log"]).alias("log"))), F.lit(0))

        return F.aggregate(some, begin(state), join)

    kind = lists.schema["_ds"].dataType.simpleString()
    # joined by sorted shuffles: where the lists are broadcast, neighbouring records and all their decisions are one task's
    listed = records.join(lists.hint("merge"), key, "left").withColumn("_ds", F.coalesce("_ds", F.array().cast(kind)))
    if "published" not in records.columns:
        listed = listed.withColumn("published", F.col("text"))
    folded = listed.withColumn("_end", over_runs(F.col("_ds"), F.struct(*STATE), (RUN * RUN, RUN)))
    after = folded.select(*[F.col(f"_end.state.{k}").alias(k) if k in STATE else F.col(k) for k in records.columns])
    applied = folded.select(key, F.inline("_end.log")).select("decision_id", key, "outcome")
    missing = fresh.join(records.select(key), key, "left_anti").select("decision_id", key, F.lit("missing").alias("outcome"))
    known = asked.where("_known").select("decision_id", key, F.lit("done").alias("outcome"))
    return after, applied.union(missing).union(known)
