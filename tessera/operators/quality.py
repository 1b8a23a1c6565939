"""Similarity and evidence measures on text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import norm_key
from tessera.sources.scratch import Scratch

#: Fixed value: a stem with a shorter key is too short to compare.
SHORTEST_KEY = 40


def duplicate_keys(stem: Column, options: Column, has_image: Column | None = None) -> Column:
    """struct<exact, near>: SHA-256 of a stem's key with its options' keys, and of the stem's key alone.

    Both are null for stems under 40 key characters and for those with an image.
    """
    sep = "\x1f"
    k = norm_key(stem)
    opts = F.replace(norm_key(F.array_join(F.coalesce(options, F.array().cast("array<string>")), sep, ""), sep), F.lit(sep), F.lit("|"))
    fine = (F.length(k) >= SHORTEST_KEY) & ~(F.coalesce(has_image, F.lit(False)) if has_image is not None else F.lit(False))
    return F.struct(F.when(fine, F.sha2(F.concat(k, F.lit("#"), opts), 256)).alias("exact"), F.when(fine, F.sha2(k, 256)).alias("near"))


def duplicate_index(keys: DataFrame, id_col: str, exact: str, near: str, most: int = 5) -> DataFrame:
    """Rows (id_col, code, partners): up to ``most`` others of the same exact key, else of the same near key.

    Spark keeps the first ids of each key before the shuffle, so a key that very many rows share sends few of them. The keys,
    which are read several times, are written once.
    """
    with Scratch(keys.sparkSession) as scratch:
        keys = scratch.keep(scratch.write(keys.select(id_col, exact, near)))

    def partners(key: str, code: str) -> DataFrame:
        d = keys.select(id_col, F.col(key).alias("k")).where("k is not null")
        r = F.row_number().over(Window.partitionBy("k").orderBy(id_col))
        few = d.withColumn("r", r).where(F.col("r") <= most + 1).groupBy("k").agg(F.array_sort(F.collect_list(id_col)).alias("ids")).where("size(ids) > 1")
        others = F.slice(F.filter("ids", lambda x: x != F.col(id_col)), 1, most)
        return d.join(few, "k").select(id_col, F.lit(code).alias("code"), others.alias("partners"))

    found = partners(exact, "exact_duplicate").union(partners(near, "near_duplicate"))
    best = found.groupBy(id_col).agg(F.min_by(F.struct("code", "partners"), "code").alias("f"))
    return best.select(id_col, "f.code", "f.partners")


def multiset_share(df: DataFrame, key: str, text: str, against: DataFrame) -> DataFrame:
    """Share of a text's characters (spaces apart) that one reference text has too, counted with multiplicity."""
    chars = lambda d: F.explode(F.split(F.lower(d), ""))
    a = df.select(key, chars(text).alias("ch")).where("ch not in ('', ' ')").groupBy(key, "ch").agg(F.count("*").alias("n"))
    b = against.select(chars(against.columns[0]).alias("ch")).where("ch not in ('', ' ')").groupBy("ch").agg(F.count("*").alias("m"))
    total = a.groupBy(key).agg(F.sum("n").alias("total"))
    return a.join(b, "ch").groupBy(key).agg(F.sum(F.least("n", "m")).alias("common")).join(total, key).select(key, F.round(F.col("common") / F.col("total"), 6).alias("share"))


def confirmed_by_editions(df: DataFrame, id_col: str, key: str, rebuilt: str, most: int = 3) -> DataFrame:
    """(id_col, siblings, confirmed): up to ``most`` other rows of the same key, and whether all of them were rebuilt alike.

    Spark keeps the first rows of each key before the shuffle. Rows without a sibling are not reported.
    """
    d = df.select(id_col, F.col(key).alias("k"), F.col(rebuilt).alias("r")).where("k is not null")
    rank = F.row_number().over(Window.partitionBy("k").orderBy(id_col))
    few = d.withColumn("n", rank).where(F.col("n") <= most + 1).groupBy("k").agg(F.array_sort(F.collect_list(F.struct(id_col, "r"))).alias("rows")).where("size(rows) > 1")
    others = F.slice(F.filter("rows", lambda x: x[id_col] != F.col(id_col)), 1, most)
    return d.join(few, "k").select(id_col, "r", others.alias("o")).select(id_col, F.size("o").alias("siblings"), F.forall("o", lambda x: x["r"].eqNullSafe(F.col("r"))).alias("confirmed"))


#: Distinct trigrams of the questions up to which they go to the pages.
BROADCAST_GRAMS = 1_000_000


def trigram_locate(questions: DataFrame, q_id: str, q_text: str, pages: DataFrame, p_id: str, p_text: str, top: int = 5) -> DataFrame:
    """The ``top`` pages per question by the share of its word trigrams that they hold.

    Only trigrams that a question has leave the pages: the questions' own go to the pages where they are few enough. Shared
    ones are counted per question and page before anything is shuffled by them. A trigram is two hashes of its words, 128 bits.
    """

    def grams(df, key, text, out):
        w = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
        three = lambda i: [F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)]
        g = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(*three(i)).alias("g"), F.xxhash64(*three(i)[::-1]).alias("r")))
        return df.select(F.col(key).alias(out), w.alias("w")).where(F.size("w") > 2).select(out, F.inline(g))

    q = grams(questions, q_id, q_text, "q").distinct()
    size = q.groupBy("q").agg(F.count("*").alias("n"))
    of = q.join(size, "q")
    few = q.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    hits = grams(pages, p_id, p_text, "p").join(F.broadcast(of) if few else of, ["g", "r"]).distinct().groupBy("q", "p").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    scored = hits.select("q", "p", F.round(F.col("k") / F.col("n"), 4).alias("score"))
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "p"))
    return scored.withColumn("r", r).where(F.col("r") <= top).drop("r")


def finding_states(previous: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Next state of each finding. ``previous``: keys, state, part_hash; ``found``: keys, part_hash.

    Found again: a dismissed one stays dismissed while its part is unchanged, an accepted one stays accepted, all others are
    open. Not found: an open one is fixed, all others keep their state.
    """
    p = previous.select(*keys, F.col("state").alias("s"), F.col("part_hash").alias("ph"))
    f = found.select(*keys, F.col("part_hash").alias("fh"), F.lit(True).alias("hit"))
    sticky = (F.col("s") == "accepted") | ((F.col("s") == "dismissed") & F.col("ph").eqNullSafe(F.col("fh")))
    state = F.when(F.col("hit"), F.when(sticky, F.col("s")).otherwise("open")).otherwise(F.when(F.col("s") == "open", "fixed").otherwise(F.col("s")))
    return p.join(f, keys, "full").select(*keys, state.alias("state"), F.coalesce("fh", "ph").alias("part_hash"))
