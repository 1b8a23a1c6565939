"""Trees of content blocks as VARIANT, walked level by level without Python, and grids of table cells.

A node is an object with a type ``t`` and children under the keys of ``CHILDREN``; lists of nodes nest freely. A walk opens one
level in each round: a row's children come from that row alone, so a round moves no data, and the depth of the deepest tree
bounds the rounds. A node's path, the places on its way from the root, sorts the nodes depth-first.

Odd input: a null tree, text that is no JSON, or a tree without nodes has no rows in a walk; the facts of such a record
are empty, its plain text is ''. A value of another kind than its key asks for is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch

#: The keys under which nodes have children, in the order of a walk.
CHILDREN = ("c", "rows", "items", "content", "header", "passage")
#: Path step behind all children of a node.
END = 2147483647
#: What may follow what in the plain text: role of a value, key (or '' for the places of a list), type of the node that holds it, role of the value found.
_TEXT_STEPS = {("node", ""): "node", ("p", "c"): "node", ("table", "rows"): "rows", ("rows", ""): "row", ("row", ""): "cell", ("cell", "c"): "node", ("list", "items"): "items", ("items", ""): "item", ("item", ""): "node"}


def _get(node: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(node), path, kind)


def walk(trees: DataFrame, id_col: str, tree: str) -> DataFrame:
    """Rows (id_col, path, depth, t, v, tex, src, review, role): every value of the trees, lists included (their t is null).

    ``tree`` is a column of JSON text or VARIANT. ``role`` tells what the value is to the plain text, null if no part of it.
    """
    column = F.col(tree) if trees.schema[tree].dataType.typeName() == "variant" else F.try_parse_json(tree)
    level = trees.select(F.col(id_col), F.array().cast("array<int>").alias("path"), F.lit("node").alias("role"), column.alias("node")).where("node is not null")
    step = lambda key, of: F.coalesce(*[F.when((of == a) & (F.lit(key) == k), b) for (a, k), b in _TEXT_STEPS.items() if k == key], F.lit(None).cast("string"))
    levels, depth = [], 0
    with Scratch(trees.sparkSession) as scratch:
        while True:
            level = scratch.keep(scratch.write(level.withColumn("t", _get("node", "$.t", "string"))))
            if level.isEmpty():
                break
            fields = [_get("node", f"$.{k}", "string").alias(k) for k in ("v", "tex", "src")]
            levels.append(level.select(id_col, "path", F.lit(depth).alias("depth"), "t", *fields, _get("node", "$.review", "boolean").alias("review"), "role"))
            # what the place in the text is: a node's type decides for its children, a list hands its own role on
            of = F.when(F.col("role").isin("node", "item") & F.col("t").isNotNull(), F.col("t")).otherwise(F.col("role"))
            kept = F.when(F.col("role") == "item", F.coalesce(F.when(F.col("t").isNull(), F.lit("item")), F.col("t"))).otherwise(of)
            inside = [F.struct(F.concat("path", F.array(F.lit(n))).alias("path"), step(k, kept).alias("role"), F.try_variant_get("node", f"$.{k}", "variant").alias("node")) for n, k in enumerate(CHILDREN)]
            listed = F.transform(_get("node", "$", "array<variant>"), lambda x, i: F.struct(F.concat(F.col("path"), F.array(i)).alias("path"), step("", F.col("role")).alias("role"), x.alias("node")))
            below = F.coalesce(listed, F.array(*inside))
            level = level.select(id_col, F.explode(below).alias("x")).select(id_col, "x.path", "x.role", "x.node").where("node is not null")
            depth += 1
    out = levels[0] if levels else level.select(id_col, "path", F.lit(0).alias("depth"), "t", *[F.col("t").alias(k) for k in ("v", "tex", "src")], F.lit(None).cast("boolean").alias("review"), "role")
    for more in levels[1:]:
        out = out.union(more)
    return out


def tree_facts(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id_col, tex, images, has_table, warns) of the trees walked: distinct formulas and image sources, both sorted, whether
    a table is there, and how many nodes are warnings or marked for review."""
    distinct = lambda t, k: F.array_sort(F.collect_set(F.when((F.col("t") == t) & (F.col(k) != ""), F.col(k))))
    warns = F.count_if((F.col("t") == "warn") | F.coalesce("review", F.lit(False)))
    return nodes.groupBy(id_col).agg(distinct("m", "tex").alias("tex"), distinct("img", "src").alias("images"), F.max(F.coalesce(F.col("t") == "table", F.lit(False))).alias("has_table"), warns.alias("warns"))


def plain_text(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id_col, text): the texts and formulas of the trees walked in reading order; a paragraph, a row and a list item end a
    line, a cell ends with a bar. A tree's pieces meet in one task."""
    t, role = F.col("t"), F.col("role")
    is_node = role.isin("node", "item")
    own = F.when(is_node & (t == "s"), F.col("v")).when(is_node & (t == "m"), F.concat(F.lit(" "), "tex", F.lit(" "))).when(is_node & t.isin("br", "tab"), F.lit(" ")).when(is_node & (t == "range"), F.lit("…"))
    after = F.concat(F.when((role == "node") & (t == "p") | (role == "item") & (t == "p"), F.lit("\n")).otherwise(F.lit("")), F.when(role == "cell", F.lit(" | ")).when(role.isin("row", "item"), F.lit("\n")).otherwise(F.lit("")))
    pieces = nodes.select(id_col, F.explode(F.array(F.struct("path", own.alias("s")), F.struct(F.concat("path", F.array(F.lit(END))).alias("path"), after.alias("s")))).alias("x"))
    joined = pieces.where("x.s <> ''").groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("text"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r"^\s+", ""), r"\s+$", "")
    return nodes.select(id_col).distinct().join(joined.select(id_col, text.alias("text")), id_col, "left").select(id_col, F.coalesce("text", F.lit("")).alias("text"))


def table_grid(cells: DataFrame, table: str, row: str, place: str, colspan: str, vmerge: str) -> DataFrame:
    """(table, row, out_place, col, colspan, rowspan) of the cells that stay, from cells in order of ``place`` in their row.

    A cell begins in the column behind those before it in its row. One that continues a vertical merge goes up into the cell
    that last began in its column, if that one opened a merge and nothing else began there since; else it stands alone.
    """
    span = F.greatest(F.coalesce(F.col(colspan), F.lit(1)), F.lit(1))
    in_row = Window.partitionBy(table, row).orderBy(place)
    so_far = in_row.rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.select(table, row, place, span.alias("_span"), F.coalesce(F.col(vmerge), F.lit("")).alias("_vm"), (F.sum(span).over(so_far) - span).alias("col"))
    down = Window.partitionBy(table, "col").orderBy(row, place)
    fresh = F.when(F.col("_vm") != "continue", F.col("_vm"))
    last = F.last(fresh, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    merged = (F.col("_vm") == "continue") & F.coalesce(last == "restart", F.lit(False))
    marked = placed.withColumn("_up", merged)
    run = F.sum((~F.col("_up")).cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    spans = marked.withColumn("_run", run)
    spans = spans.withColumn("_rowspan", F.count("*").over(Window.partitionBy(table, "col", "_run")))
    at = F.sum((~F.col("_up")).cast("int")).over(so_far)
    return spans.withColumn("_at", at).where(~F.col("_up")).select(table, row, (F.col("_at") - 1).alias("out_place"), F.col("col"), F.col("_span").alias("colspan"), F.col("_rowspan").alias("rowspan"))
