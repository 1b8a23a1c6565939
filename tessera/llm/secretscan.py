"""Secret scans with multipart credential linking, from Spark SQL functions alone.

Strong spans stand by themselves: assignments of a secret, access identifiers, long hexadecimal runs. Weak candidates (login
names, unassigned key-like runs, endpoints) say nothing alone. Each access identifier or login opens a scope: what lies within
``SCOPE`` code points of it and in its block of text, which blank lines bound. An interval join over cells of text brings
the secrets and endpoints of a scope to its identifier; only where the scope holds both are its weak parts reported.

Positions come from the lengths of matches and of what stands between them, added up by a window within the document.
A pair is made in one cell only, that of the part's start, and matches of a kind do not overlap, so the pairs of a scope are
bounded by its width.

Handling of odd input: null and empty texts have no spans; each row is a document of its own, also if its id is null or
repeats; very long texts are read whole, their matches, not the text, meet in one task; ties of the start are ordered by
kind, then end; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def either_case(word: str) -> str:
    return "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in word)


def _assigned(names: str, value: str) -> str:
    return rf"""({"|".join(either_case(n) for n in names.split())})["']?\x20*[:=]\x20*["']?({value})"""


#: Kinds in their order, with their patterns. Of the first, matches with a shorter group 2 than ``SHORTEST`` are dropped.
#: Runs are maximal, so their least lengths stand in the pattern. BLANK is where a block ends.
KINDS = ["assign", "access", "hex", "login", "key", "endpoint"]
ASSIGN, ACCESS, HEX, LOGIN, KEY, ENDPOINT, BLANK = range(7)
SHORTEST, SCOPE, CELL = 6, 300, 512
PATTERNS = [
    _assigned("password passwd secret token api_?key", "[A-Za-z0-9+/_.=-]+"),
    "AKIA[A-Z0-9]{16,}",
    "[0-9a-f]{24,}",
    _assigned("username user login account client_?id key_?id", "[A-Za-z0-9+/_.@=-]{3,}"),
    "[A-Za-z0-9+/_=-]{16,}",
    r"""(https?|ftps?|wss?|ssh|amqps?|redis|mysql|postgres|postgresql|mongodb)://[^\x00-\x20"'<>]+""",
    r"\n[\x20\x09\x0B-\x0D]*\n",
]


def _matches(text: Column, kind: int) -> Column:
    """Structs (kind, pos, gap, len, good) of the leftmost matches that do not overlap, in order."""
    pattern = PATTERNS[kind]
    good = {
        ASSIGN: lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= SHORTEST,
        KEY: lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
    }.get(kind, lambda m: F.lit(True))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), good(m).alias("good")))
    numbered = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x["gap"].alias("gap"), x["len"].alias("len"), x["good"].alias("good")))
    return F.when(text.rlike(pattern), F.filter(numbered, lambda x: x["len"].isNotNull()))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (row, id, found): the matches of every document, those of weak kinds where a scope can be complete."""
    text = F.col("text")
    weak = text.rlike(PATTERNS[ENDPOINT]) & (text.rlike(PATTERNS[LOGIN]) | text.rlike(PATTERNS[ACCESS]))
    none = F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,good:boolean>>")
    found = [F.coalesce(_matches(text, k), none) for k in (ASSIGN, ACCESS, HEX)] + [F.coalesce(F.when(weak, _matches(text, k)), none) for k in (LOGIN, KEY, ENDPOINT, BLANK)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return materialize(rows.select("row", "id", F.concat(*found).alias("found")))


def _placed(found: DataFrame) -> DataFrame:
    """Rows (row, id, kind, start, end, block, touched) of all good matches; touched: one of a kind but KEY overlaps it."""
    each = found.select("row", "id", F.inline("found"))
    so_far = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(so_far).cast("long")
    each = each.select("row", "id", "kind", (end - F.col("len")).alias("start"), end.alias("end"), "good").where("good").drop("good")
    order = Window.partitionBy("row").orderBy("start", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    firm = ~F.col("kind").isin(KEY, BLANK)
    block = F.sum((F.col("kind") == BLANK).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max(F.when(firm, F.col("end"))).over(before)
    following = F.min(F.when(firm, F.col("start"))).over(after)
    touched = F.coalesce(last > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))
    return materialize(each.select("row", "id", "kind", "start", "end", block.alias("block"), touched.alias("touched")).where(F.col("kind") != BLANK))


def _linked(placed: DataFrame) -> DataFrame:
    """Weak parts (row, id, kind, start, end) of the scopes that hold a secret and an endpoint, each once."""
    low, high = F.col("start") - SCOPE, F.col("end") + SCOPE
    scopes = placed.where(F.col("kind").isin(ACCESS, LOGIN)).select("row", "id", "block", F.col("kind").alias("of"), F.col("start").alias("s"), F.col("end").alias("e"), low.alias("low"), high.alias("high"))
    scopes = scopes.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / CELL), F.floor(F.col("high") / CELL))))
    parts = placed.where(F.col("kind").isin(ASSIGN, HEX, ENDPOINT) | ((F.col("kind") == KEY) & ~F.col("touched")))
    parts = parts.select("row", "block", "kind", "start", "end", F.floor(F.col("start") / CELL).alias("cell"))
    pairs = scopes.join(parts, ["row", "block", "cell"]).where("start >= low AND end <= high AND (end <= s OR start >= e)")
    scope = Window.partitionBy("row", "of", "s")
    holds = lambda test: F.max(test).over(scope)
    whole = pairs.select("*", holds(F.col("kind").isin(ASSIGN, HEX, KEY)).alias("secret"), holds(F.col("kind") == ENDPOINT).alias("reach")).where("secret AND reach")
    reported = whole.select("row", "id", F.inline(F.array(F.struct("kind", "start", "end"), F.struct(F.col("of").alias("kind"), F.col("s").alias("start"), F.col("e").alias("end")))))
    return reported.where(F.col("kind") > HEX).distinct()


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_assign, n_access, n_hex, base, spans): lists of structs (start, kind, end) in order, ``kind`` an
    index of ``KINDS``; ``base`` holds the strong spans, ``spans`` the linked weak ones as well."""
    found = _spans(docs, id_col, text_col)
    placed = _placed(found)
    spans = placed.where(F.col("kind") <= HEX).select("row", "id", "kind", "start", "end").union(_linked(placed))
    null = [F.lit(None).cast(t) for t in ("int", "long", "long")]
    spans = spans.union(found.where(F.size("found") > 0).select("row", "id", *null))  # a document keeps its row if all its matches are dropped
    count = lambda k: F.count_if(F.col("kind") == k)
    held = spans.groupBy("row", "id").agg(count(ASSIGN).alias("n_assign"), count(ACCESS).alias("n_access"), count(HEX).alias("n_hex"), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("spans"))
    held = held.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", F.filter("spans", lambda x: x["kind"] <= HEX).alias("base"), "spans")
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    bare = found.where(F.size("found") == 0).select(F.col("id").alias(id_col), zero.alias("n_assign"), zero.alias("n_access"), zero.alias("n_hex"), empty.alias("base"), empty.alias("spans"))
    return held.unionByName(bare)


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
