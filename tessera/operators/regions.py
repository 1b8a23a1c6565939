"""Regions of ordered lines between markers, over page borders, and ordered fragments in a source text.

Lines have an order within a document, whatever page they stand on. The last opening marker is carried down to the lines that
follow it, so a region needs no join and no page is its border. Odd input: null flags are false; lines of equal order are put
in no defined order, so the order columns must tell them apart; a document without markers has no regions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def label_regions(lines: DataFrame, doc: str, order: list[str], label: str, stops: str) -> DataFrame:
    """``lines`` in a region, with ``region`` (from 1 in a document), ``name`` and ``line_no`` (from 0 in its region).

    A line with a ``label`` opens a region and belongs to it; one that ``stops`` closes it and belongs to it too. Lines after
    that, up to the next label, and those before the first label are in none.
    """
    down = Window.partitionBy(doc).orderBy(*order)
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col(label).isNotNull()
    marked = lines.withColumn("region", F.sum(opens.cast("int")).over(so_far)).where("region > 0")
    inside = Window.partitionBy(doc, "region").orderBy(*order)
    closed = F.sum(_yes(F.col(stops)).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    named = marked.withColumn("name", F.last(label, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return named.withColumn("_closed", F.coalesce(closed, F.lit(0))).where("_closed = 0").drop("_closed").withColumn("line_no", F.row_number().over(inside) - 1)


def region_texts(lines: DataFrame, doc: str, order: list[str], label: str, stops: str, page: str, text: str, most_pages: int = 3) -> DataFrame:
    """(doc, region, name, first_page, last_page, lines, text) of each region; one over more than ``most_pages`` pages is
    unresolved: its text is null."""
    found = label_regions(lines, doc, order, label, stops)
    whole = found.groupBy(doc, "region", "name").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("line_no", F.col(text).alias("s")))).alias("x"))
    joined = F.array_join(F.transform("x", lambda x: F.coalesce(x["s"], F.lit(""))), "\n")
    return whole.select(doc, "region", "name", "first_page", "last_page", "lines", F.when(F.col("last_page") - F.col("first_page") < most_pages, joined).alias("text"))


#: How far a question looks back for its instruction, an instruction for its marker, and the least length of a passage.
BACK, MARKER_BACK, SHORTEST_PASSAGE = 600, 25, 300
#: The reasons, in the order in which they are tried.
REASONS = ("no_instruction", "other_passage_between", "no_marker", "not_plain", "question_lines", "too_short")


def recover_passages(paras: DataFrame, doc: str, at: str, text: str, question: str, instruction: str, marker: str, foreign: str, plain: str) -> DataFrame:
    """(doc, at, reason, first, last, passage) of every question paragraph: the shared passage that it belongs to.

    ``paras`` are numbered from 0 without gaps by ``at``; ``question``, ``instruction``, ``marker``, ``foreign`` (a line that can be in no
    passage) and ``plain`` (running text) are flags. The instruction is the last within ``BACK`` paragraphs before the question,
    with no marker between them. If it is a marker itself, the passage follows it up to the first foreign line; else it stands
    between the last marker within ``MARKER_BACK`` paragraphs before the instruction and the instruction. ``first`` is the passage's
    first paragraph, ``last`` the one behind it; ``passage`` joins its paragraphs that are not blank, null with a reason.

    Totals over a passage are differences of running sums that its two ends carry; only its paragraphs are joined for the text.
    """
    down = Window.partitionBy(doc).orderBy(at)
    upto, above = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    flag = lambda k: _yes(F.col(k))
    body = F.coalesce(F.col(text), F.lit(""))
    blank = F.trim(body) == ""  # of spaces
    base = paras.select(doc, at, body.alias("_text"), *[flag(k).alias(f"_{n}") for n, k in (("q", question), ("h", instruction), ("m", marker), ("x", foreign), ("p", plain))], blank.alias("_blank"))
    # sums over all paragraphs above this one
    sums = [F.coalesce(F.sum(v.cast("long")).over(above), F.lit(0)).alias(k) for k, v in (("odd", ~F.col("_p")), ("bad", F.col("_x") & ~F.col("_blank")), ("size", F.when(F.col("_blank"), 0).otherwise(F.length("_text"))))]
    run = base.select("*", F.struct(F.col(at).alias("at"), *sums).alias("_here"))
    below = F.lead("_here").over(down)  # the sums with this paragraph
    run = run.withColumn("_below", F.coalesce(below, F.struct((F.col(at) + 1).alias("at"), (F.col("_here.odd") + (~F.col("_p")).cast("long")).alias("odd"), (F.col("_here.bad") + (F.col("_x") & ~F.col("_blank")).cast("long")).alias("bad"), (F.col("_here.size") + F.when(F.col("_blank"), 0).otherwise(F.length("_text"))).alias("size"))))
    last_marker = F.last(F.when(F.col("_m"), F.col("_below")), ignorenulls=True)
    run = run.withColumn("_before", last_marker.over(above))
    head = F.struct(F.col(at).alias("at"), F.col("_m").alias("is_marker"), F.col("_here").alias("here"), F.col("_below").alias("below"), F.col("_before").alias("marker"))
    run = run.withColumn("_head", F.last(F.when(F.col("_h"), head), ignorenulls=True).over(above)).withColumn("_group", F.sum(F.col("_h").cast("int")).over(upto) - F.col("_h").cast("int"))
    first_foreign = F.first(F.when(F.col("_x"), F.col("_here")), ignorenulls=True).over(Window.partitionBy(doc, "_group").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    asked = run.withColumn("_stop", first_foreign).where("_q")
    near = F.col("_head").isNotNull() & (F.col(at) - F.col("_head.at") <= BACK)
    between = F.coalesce(F.col("_before.at") - 1 > F.col("_head.at"), F.lit(False))
    has_marker = F.coalesce(F.col("_head.at") - (F.col("_head.marker.at") - 1) <= MARKER_BACK, F.lit(False))
    after = F.col("_head.is_marker")
    first, last = F.when(after, F.col("_head.below")).otherwise(F.col("_head.marker")), F.when(after, F.coalesce("_stop", "_here")).otherwise(F.col("_head.here"))
    asked = asked.select(doc, at, near.alias("near"), between.alias("between"), (after | has_marker).alias("marked"), first.alias("a"), last.alias("z"))
    total = lambda k: F.col(f"z.{k}") - F.col(f"a.{k}")
    tried = [~F.col("near"), F.col("between"), ~F.col("marked"), total("odd") > 0, total("bad") > 0, total("size") < SHORTEST_PASSAGE]
    reason = F.coalesce(*[F.when(_yes(test), F.lit(name)) for test, name in zip(tried, REASONS, strict=True)])
    judged = asked.select(doc, at, reason.alias("reason"), F.when(reason.isNull(), F.col("a.at")).alias("first"), F.when(reason.isNull(), F.col("z.at")).alias("last"))
    # questions of one group have the same passage: it is put together once
    ranges = judged.where("reason is null").select(doc, "first", "last").distinct()
    inside = ranges.withColumn(at, F.explode(F.sequence(F.col("first"), F.col("last") - 1))).join(base.where("not _blank").select(doc, at, "_text"), [doc, at])
    texts = inside.groupBy(doc, "first", "last").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "_text"))), lambda x: x["_text"]), "\n").alias("passage"))
    return judged.join(texts, [doc, "first", "last"], "left").select(doc, at, "reason", "first", "last", "passage")


#: How far a stem fragment may be from the one before it, the options from the stem, the passage before it;
#: the least key lengths of a stem, a fragment and a passage; how much of each is looked for.
STEM_GAP, OPTION_SPAN, PASSAGE_BACK = 3000, 6000, 30000
SHORTEST_STEM, SHORTEST_FRAGMENT, SHORTEST_PROBE = 12, 4, 20
STEM_PROBE, STEM_SECOND, FRAGMENT_PROBE, PASSAGE_PROBE = 60, 40, 80, 60


def verify_fragments(questions: DataFrame, pages: str, stem: str, options: str, passage: str) -> DataFrame:
    """``questions`` with reason (null: it holds), failing, page and twice, against their own sources; all texts are keys.

    ``pages`` are the source's pages; the fragments of the ``stem`` must follow each other in their joined text, each within
    ``STEM_GAP`` of the one before, the options in their order within ``OPTION_SPAN`` from the stem on, and the passage must begin
    at most ``PASSAGE_BACK`` before it. ``failing`` names the first fragment, the numbers of the options (from 1) or the begin of the
    passage that fails. ``page`` (from 1) holds the begin of the stem, ``twice`` tells that it occurs again. The folds carry a
    position and what failed, no list that grows with them.
    """
    c, none = F.col, F.lit(None).cast("string")
    given = questions.withColumns({"_source": F.array_join(pages, ""), "_whole": F.array_join(stem, "")})
    long, short = F.substring("_whole", 1, STEM_PROBE), F.substring("_whole", 1, STEM_SECOND)
    found = given.withColumn("_probe", F.when(F.contains(c("_source"), long), long).otherwise(short)).withColumn("_pos", F.position("_probe", c("_source")))
    low = F.greatest(c("_pos") - PASSAGE_BACK, F.lit(1))
    cut = found.withColumns({"_window": F.substring(c("_source"), c("_pos"), F.lit(OPTION_SPAN)), "_above": F.substring(c("_source"), low, c("_pos") - low + 1)})
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  names a value that is used twice

    def next_fragment(acc: Column, piece: Column) -> Column:
        at = F.position(F.substring(piece, 1, FRAGMENT_PROBE), c("_source"), acc["at"])
        moved = once(at, lambda k: F.struct(k.alias("at"), F.when((k == 0) | (k - acc["at"] > STEM_GAP), piece).alias("failing")))
        return F.when(acc["failing"].isNull(), moved).otherwise(acc)

    def next_option(acc: Column, option: Column) -> Column:
        n, lost = acc["n"] + 1, F.concat_ws(",", acc["lost"], (acc["n"] + 1).cast("string"))
        moved = once(F.position(option, c("_window"), acc["at"]), lambda k: F.struct(F.when(k > 0, k + 1).otherwise(acc["at"]).alias("at"), n.alias("n"), F.when(k > 0, acc["lost"]).otherwise(lost).alias("lost")))
        return F.when(F.length(option) > 0, moved).otherwise(F.struct(acc["at"].alias("at"), n.alias("n"), acc["lost"].alias("lost")))

    pieces = F.filter(stem, lambda x: F.length(x) >= SHORTEST_FRAGMENT)
    lost_piece = F.aggregate(pieces, F.struct(c("_pos").alias("at"), none.alias("failing")), next_fragment)["failing"]
    lost_options = F.aggregate(F.coalesce(options, F.array().cast("array<string>")), F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"), none.alias("lost")), next_option)["lost"]
    page = F.aggregate(pages, F.struct(F.lit(0).alias("n"), F.lit(1).alias("start"), F.lit(None).cast("int").alias("page")), lambda acc, p: F.struct((acc["n"] + 1).alias("n"), (acc["start"] + F.length(p)).alias("start"), F.when(acc["page"].isNull() & (acc["start"] + F.length(p) > c("_pos")), acc["n"] + 1).otherwise(acc["page"]).alias("page")))["page"]
    tested = cut.withColumns({"_piece": lost_piece, "_options": lost_options, "_passage": F.substring(c(passage), 1, PASSAGE_PROBE)})
    far = (F.length("_passage") >= SHORTEST_PROBE) & ~F.contains(c("_above"), c("_passage"))
    reason = F.when(F.length("_whole") < SHORTEST_STEM, "stem_too_short").when(c("_pos") == 0, "stem_not_found").when(c("_piece").isNotNull(), "stem_fragment").when(c("_options").isNotNull(), "options").when(far, "passage")
    judged = tested.withColumn("reason", reason)
    failing = F.when(c("reason") == "stem_fragment", c("_piece")).when(c("reason") == "options", c("_options")).when(c("reason") == "passage", c("_passage"))
    located = F.coalesce(c("reason") != "stem_too_short", F.lit(True)) & (c("_pos") > 0)
    out = judged.withColumns({"failing": failing, "page": F.when(located, page), "twice": located & (F.position("_probe", c("_source"), c("_pos") + 1) > 0)})
    return out.drop("_source", "_whole", "_probe", "_pos", "_window", "_above", "_piece", "_options", "_passage")
