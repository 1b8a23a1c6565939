"""Reports of a whole bank in long form: (section, name, n) rows, each table read once, whatever the number of figures.

Odd input: null flags count as false, null keys under '?', empty tables give zeros where a figure is a count and no row where it
is a group; a ratio without a base is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _figures(df: DataFrame, section: str, figures: dict[str, Column]) -> DataFrame:
    """One pass over ``df``: each figure is an aggregate, each a row of the result."""
    row = df.agg(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("n")) for k, v in figures.items()]).alias("x"))
    return row.select(F.lit(section).alias("section"), F.inline("x"))


def _grouped(df: DataFrame, section: str, key: Column, n: Column | None = None) -> DataFrame:
    return df.groupBy(F.coalesce(key.cast("string"), F.lit("?")).alias("name")).agg((n if n is not None else F.count("*")).cast("double").alias("n")).select(F.lit(section).alias("section"), "name", "n")


def _stack(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def admin_dashboard(users: DataFrame, periods: DataFrame, sessions: DataFrame, items: DataFrame, used: DataFrame, orders: DataFrame, transactions: DataFrame, now: Column) -> DataFrame:
    """Users by plan and age, practice, exams, payments and activity by day.

    ``users``: user_id, role, created_at. ``periods``: user_id, status, starts_at, expires_at. ``sessions``: session_id, user_id, mode, status,
    created_at, plan. ``items``: session_id, subject, answered_at. ``used``: session_id of paid attempts. ``orders``: status, kind,
    paid_amount, amount, paid_at. ``transactions``: status.
    """
    c = F.col
    since = lambda at, days: F.coalesce(at >= now - F.make_interval(days=F.lit(days)), F.lit(False))
    held = periods.where("status = 'active'").groupBy("user_id").agg(F.max((c("starts_at") <= now) & (c("expires_at") > now)).alias("pro"))
    people = users.join(held, "user_id", "left").withColumn("student", F.coalesce(c("role") == "student", F.lit(False)))
    pro = F.count_if(c("student") & F.coalesce("pro", F.lit(False)))
    told = _figures(people, "users", {
        "total": F.count("*"), "students": F.count_if("student"), "admins": F.count_if(F.coalesce(c("role") == "admin", F.lit(False))), "pro_active": pro, "free": F.count_if("student") - pro, "pro_expired": F.count_if(c("student") & ~c("pro")),
        **{f"new_{d}d": F.count_if(since(c("created_at"), d)) for d in (1, 7, 30)},
    })
    paid = used.select("session_id").distinct().withColumn("paid", F.lit(True))
    marked = sessions.join(paid, "session_id", "left").withColumn("recent", since(c("created_at"), 30))
    practice, exam = c("mode") == "practice", c("mode") == "exam"
    done = F.count_if(exam & (c("status") == "submitted"))
    seen = _figures(marked, "sessions", {
        "active_7d": F.count_distinct(F.when(since(c("created_at"), 7), c("user_id"))), "active_30d": F.count_distinct(F.when(c("recent"), c("user_id"))), "practice": F.count_if(practice), "practice_30d": F.count_if(practice & c("recent")), "exams": F.count_if(exam), "exams_30d": F.count_if(exam & c("recent")),
        **{s: F.count_if(exam & (c("status") == s)) for s in ("submitted", "in_progress", "abandoned")}, "paid_attempts": F.count_if(exam & c("paid")), "free_attempts": F.count_if(exam & c("paid").isNull()), "completion_rate": F.round(F.try_divide(done, F.count_if(exam)), 3),
    })
    answered = items.where("answered_at is not null").groupBy("session_id", "subject").agg(F.count("*").alias("k")).join(sessions.where(practice).select("session_id"), "session_id")
    sold = c("status") == "paid"
    worth = F.coalesce("paid_amount", "amount")
    money = _figures(orders, "payments", {
        "revenue": F.coalesce(F.sum(F.when(sold, worth)), F.lit(0)), "revenue_30d": F.coalesce(F.sum(F.when(sold & since(c("paid_at"), 30), worth)), F.lit(0)), "revenue_pro": F.coalesce(F.sum(F.when(sold & (c("kind") == "pro"), worth)), F.lit(0)), "revenue_exam": F.coalesce(F.sum(F.when(sold & c("kind").isin("exam", "product"), worth)), F.lit(0)),
    })
    return _stack(
        told, seen, _grouped(sessions.where(practice), "sessions_by_plan", c("plan")), _grouped(answered, "answered_by_subject", c("subject"), F.sum("k")), money, _grouped(orders, "orders_by_status", c("status")),
        _figures(transactions, "transactions", {"unmatched": F.count_if(F.coalesce(c("status").isin("unmatched", "underpaid", "late"), F.lit(False)))}),
        _grouped(marked.where("recent"), "activity", F.concat_ws(" ", F.date_format("created_at", "yyyy-MM-dd"), "mode")),
    )


FUNNEL = ("upstream_total", "upstream_ready", "review_required", "mismatch_out", "effective", "eligible", "served", "admin_overrides", "mismatch_in", "student_api", "free_accessible", "excluded")


def reconciliation(questions: DataFrame, free_limit: int, none: str = "_none", general: str = "general") -> DataFrame:
    """(subject, ...) with the columns of ``FUNNEL``, a row a subject that is a bank's final subject or an app's, and ``total``.

    ``questions``: upstream (null: no final subject), subject (null: none), ready, eligible, served, auto, free, in_review, by_admin. What is
    counted by the upstream subject and what by the app's meet by one aggregation of (upstream, subject) pairs, read twice.
    """
    c = F.col
    up, eff = F.coalesce("upstream", F.lit(general)), F.coalesce("subject", F.lit(none))
    yes = lambda k: F.count_if(F.coalesce(c(k), F.lit(False)))
    shown = F.count_if(F.coalesce(c("served") & c("auto"), F.lit(False)))
    free = F.count_if(F.coalesce(c("served") & c("auto") & c("free"), F.lit(False)))
    pairs = questions.groupBy(up.alias("up"), eff.alias("eff")).agg(F.count("*").alias("n"), *[yes(k).alias(k) for k in ("ready", "eligible", "served", "in_review", "by_admin")], shown.alias("shown"), free.alias("open"))
    apart = F.when(c("up") != c("eff"), c("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    by_up = pairs.select(c("up").alias("subject"), c("n").alias("upstream_total"), c("ready").alias("upstream_ready"), c("in_review").alias("review_required"), apart.alias("mismatch_out"), *[zero.alias(k) for k in FUNNEL[4:10]], zero.alias("open"))
    by_app = pairs.select(c("eff").alias("subject"), *[zero.alias(k) for k in FUNNEL[:4]], c("n").alias("effective"), "eligible", "served", c("by_admin").alias("admin_overrides"), apart.alias("mismatch_in"), c("shown").alias("student_api"), "open")
    each = by_up.union(by_app).groupBy("subject").agg(*[F.sum(k).alias(k) for k in (*FUNNEL[:10], "open")])
    open_ = F.when((c("student_api") > 0) & (c("subject") != none), F.least("open", F.lit(free_limit))).otherwise(0).cast("long")
    each = each.withColumn("free_accessible", open_).withColumn("excluded", c("effective") - c("served")).select("subject", *FUNNEL)
    return each.union(each.agg(F.lit("total").alias("subject"), *[F.sum(k).alias(k) for k in FUNNEL]))


def bank_profile(questions: DataFrame, upstream: DataFrame, checks: DataFrame, assets: DataFrame, samples: int = 20) -> tuple[DataFrame, DataFrame]:
    """The audit of a bank: (section, name, n) rows, and (name, ids) with the first ``samples`` ids of each problem.

    ``questions``: id, state, subject, subject_source, served, mode, reasons, content (null: no version), answer, solution, group_key,
    has_passage, flags, images, formulas, shown_formulas. ``upstream``: id, has_answer, has_solution. ``checks``: sha, ok. ``assets``: sha. A
    question's own figures come from one pass; distinct formulas are compared by hash with what was checked.
    """
    c = F.col
    is_ = lambda x: F.coalesce(x, F.lit(False))
    none = F.array().cast("array<string>")
    both = questions.join(upstream.withColumn("known", F.lit(True)), "id", "full")
    here, served = c("in_app"), is_(c("served"))
    both = both.withColumn("in_app", c("state").isNotNull() | c("subject_source").isNotNull()).withColumn("images", F.coalesce("images", none))
    known = assets.select(c("sha").alias("image")).distinct()
    lost = both.where(here).select("id", F.explode("images").alias("image")).join(known, "image", "left_anti").groupBy("id").agg(F.min("image").alias("lost_image"))
    both = both.join(lost, "id", "left")
    version = here & c("content").isNotNull()
    dropped = version & is_(c("has_solution")) & c("solution").isNull()
    lapsed = version & is_(c("has_answer")) & c("answer").isNull()
    bare = version & c("group_key").isNotNull() & ~is_(c("has_passage")) & ~F.array_contains(F.coalesce("flags", none), "group_context_missing")
    problems = {"missing_from_app": ~here, "extra_in_app": here & c("known").isNull(), "trusted_answer_not_usable": lapsed, "missing_asset": c("lost_image").isNotNull(), "solution_dropped": dropped, "group_passage_empty_unflagged": bare}
    figures = {
        "questions": F.count_if(here), **{k: F.count_if(v) for k, v in problems.items()}, "missing_subject": F.count_if(here & c("subject").isNull()), "missing_version": F.count_if(here & c("content").isNull()), "served": F.count_if(version & served), "with_answer": F.count_if(version & c("answer").isNotNull()),
        "with_solution": F.count_if(version & c("solution").isNotNull()), "in_group": F.count_if(version & c("group_key").isNotNull()), "with_images": F.count_if(version & (F.size("images") > 0)), "served_missing_assets": F.count_if(served & c("lost_image").isNotNull()), "with_formula": F.count_if(version & (F.size(F.coalesce("formulas", none)) > 0)),
    }
    app = both.where(here)
    ready = c("state") == "READY_TO_SERVE"
    cause = F.when(ready, F.concat(F.lit("app_check:"), F.coalesce(F.get(F.coalesce("reasons", none), F.lit(0)), F.lit("admin_disabled")))).otherwise(c("state"))
    tex = lambda k, where: both.where(where).select(F.explode(F.coalesce(k, none)).alias("f")).select(F.sha2("f", 256).alias("sha")).distinct()
    every = tex("formulas", version).withColumn("served", F.lit(False)).union(tex("formulas", version & served).withColumn("served", F.lit(True))).groupBy("sha").agg(F.max("served").alias("served"))
    seen = tex("shown_formulas", version & served).withColumn("shown", F.lit(True))
    judged = every.join(checks.groupBy("sha").agg(F.min("ok").alias("ok")), "sha", "left").join(seen, "sha", "left")
    failing = is_(~c("ok"))
    formulas = _figures(judged, "formulas", {"distinct": F.count("*"), "served": F.count_if("served"), "checked": F.count("ok"), "failing": F.count_if(failing), "failing_served": F.count_if(failing & c("served")), "failing_shown": F.count_if(failing & is_(c("shown")))})
    report = _stack(
        _figures(both, "counts", figures), _grouped(app, "state", c("state")), _grouped(app, "subject", c("subject")), _grouped(app, "subject_source", c("subject_source")), _grouped(app.where(version & served), "served_by_subject", c("subject")), _grouped(app.where(version & served), "served_by_mode", c("mode")),
        _grouped(app.where(version & ~served), "excluded_by_cause", cause), _grouped(app.where(version).select(F.explode("reasons").alias("r")), "reasons", c("r")), formulas,
    )
    listed = both.select("id", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in problems.items()]))).alias("name"))
    # the smallest ids are kept by each task before they meet
    from pyspark.sql import Window

    first = listed.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("r") <= samples)
    return report, first.groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids"))
