"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is its copy rate; every document gets the whole part of the rate, and the
fraction is rounded dependently: two documents meet, and words move from one's probability to the other's
(at random, so that expectations stay) until one of them is certain. The other goes on as the residual. The
words expected of a source never change, so only its last residual misses the target; that one goes to the
nearer side, and documents of the source's first block are turned, large ones first, to make up for it.

Documents meet in blocks of about FAN by a hash of doc_id; the residuals of the blocks meet in blocks of
blocks, and so on: a reduction tree of depth log(documents) / log(FAN). Only SQL functions are used; all
chance comes from hashes of doc_id and a seed, so reruns agree.

Defined cases: a null text has size 0; a null source is a source, last in order; documents of size 0 give no
words; an empty table gives no rows; of rows alike in doc_id and size some get one more copy, the others none;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FAN = 64
MOST = 3
#: A group of m rows alike: base copies of each, one more of `whole` of them, and of a further one with probability p.
ITEM = "struct<doc_id: bigint, size: bigint, m: bigint, base: int, whole: bigint, p: double>"
DONE = "struct<doc_id: bigint, size: bigint, m: bigint, base: int, whole: bigint, up: int>"
FIELDS = ("doc_id", "size", "m", "base", "whole")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words."""
    bare = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(common.BLANKS))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{common.BLANKS}]+")))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words.cast("long").alias("size"))


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, n, target: all words shared out by weights 1, 2, 3, at most MOST times a source's size.

    The excess of capped sources is shared again by weight: with sources in order of cap over weight, the
    level at which the rest takes all that is left is exact once no further source is capped.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", MOST * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", left / weight)
    # The level of the first source that stays below its cap holds for all after it.
    open_level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(Window.partitionBy())
    per = per.withColumn("water", F.coalesce(open_level["level"], F.col("level")))
    return per.select("source", "source_size", "n", F.least(F.col("cap").cast("double"), F.col("water") * F.col("w")).alias("target"))


def _fold(seed: int, level: int) -> str:
    r, x = "s.res", "x"
    up_a = "least(s.res.size * (1 - s.res.p), x.size * x.p)"
    up_b = "least(s.res.size * s.res.p, x.size * (1 - x.p))"
    chance = f"((xxhash64(s.res.doc_id, x.doc_id, {seed}, {level}) & 9007199254740991) / 9007199254740992D)"
    fields = lambda who: ", ".join(f"'{c}', {who}.{c}" for c in FIELDS)
    done = lambda who, up: f"concat(s.out, array(named_struct({fields(who)}, 'up', {up})))"
    with_p = lambda who, p: f"named_struct({fields(who)}, 'p', least(1D, greatest(0D, {p})))"
    step = lambda res, out: f"named_struct('res', {res}, 'out', {out})"
    a = f"if(s.res.size * (1 - s.res.p) <= x.size * x.p, {step(with_p(x, 'x.p - s.res.size * (1 - s.res.p) / x.size'), done(r, 1))}, {step(with_p(r, 's.res.p + x.size * x.p / s.res.size'), done(x, 0))})"
    b = f"if(s.res.size * s.res.p <= x.size * (1 - x.p), {step(with_p(x, 'x.p + s.res.size * s.res.p / x.size'), done(r, 0))}, {step(with_p(r, 's.res.p - x.size * (1 - x.p) / s.res.size'), done(x, 1))})"
    return f"aggregate(items, named_struct('res', cast(null as {ITEM}), 'out', cast(array() as array<{DONE}>)), (s, x) -> if(s.res is null, {step('x', 's.out')}, if({chance} * ({up_a} + {up_b}) < {up_b}, {a}, {b})))"


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row."""
    rows = common.written(sizes(docs), "sizes")
    per = common.written(targets(rows), "targets")
    rates = per.select(F.col("source").alias("_source"), "n", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    # Rows alike in doc_id and size are one item, counted before the shuffle: however many, they take no room.
    alike = rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m"))
    rated = alike.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    rated = rated.withColumn("base", F.least(F.floor("rate"), F.lit(MOST)).cast("int")).withColumn("more", F.col("m") * F.least(F.lit(1.0), F.col("rate") - F.col("base")))
    rated = rated.withColumn("whole", F.floor("more")).withColumn("p", F.col("more") - F.col("whole"))
    certain = (F.col("p") <= 0) | (F.col("size") <= 0)
    results = [rated.where(certain).select("source", *FIELDS, F.lit(0).alias("up"))]
    item = F.struct(*FIELDS, "p").alias("item")
    open_rows = rated.where(~certain).select("source", F.expr(f"cast(ceil(n / {FAN}) as bigint)").alias("blocks"), item)
    level = 0
    while True:
        mark = F.xxhash64(F.col("item.doc_id"), F.col("item.size"), F.lit(seed), F.lit(level))
        dealt = open_rows.withColumn("block", F.pmod(mark, F.col("blocks")))
        grouped = dealt.groupBy("source", "blocks", "block").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("item.doc_id", F.lit(seed + 1), F.lit(level)).alias("h"), "item"))).alias("marked"))
        folded = grouped.withColumn("items", F.transform("marked", lambda m: m["item"])).withColumn("folded", F.expr(_fold(seed, level)))
        folded = common.written(folded.select("source", "blocks", "block", "folded"), f"level{level}")
        if level == 0:
            reserve = folded.where("block = 0").select("source", F.col("folded.out").alias("held"))
        settled = folded.where("block <> 0") if level == 0 else folded
        results.append(settled.select("source", F.explode("folded.out").alias("d")).select("source", "d.*"))
        residual = folded.where("folded.res is not null").select("source", "blocks", F.col("folded.res").alias("item"))
        if (residual.agg(F.max("blocks")).first()[0] or 1) <= 1:
            break
        # A source with one block is at its root already; it goes through further rounds unchanged.
        open_rows = residual.withColumn("blocks", F.expr(f"cast(ceil(blocks / {FAN}) as bigint)"))
        level += 1
    # The last residual of a source goes to the nearer side; documents of the source's first block make up for it.
    root = residual.select(F.col("source").alias("_source"), "item")
    ended = reserve.join(root, F.col("source").eqNullSafe(F.col("_source")), "full").select(F.coalesce("source", "_source").alias("source"), F.coalesce("held", F.expr(f"cast(array() as array<{DONE}>)")).alias("held"), "item")
    ended = ended.withColumn("last", F.when(F.col("item.p") >= 0.5, 1).otherwise(0)).withColumn("over", F.coalesce(F.col("item.size") * (F.col("last") - F.col("item.p")), F.lit(0.0)))
    ended = ended.withColumn("held", F.expr("transform(array_sort(transform(held, d -> struct(-d.size as s, xxhash64(d.doc_id) as h, d as d))), m -> m.d)"))
    flip = "x.up = if(over > 0, 1, 0) and x.size <= s.left"
    ended = ended.withColumn("held", F.expr(f"""aggregate(held, named_struct('left', abs(over), 'out', cast(array() as array<{DONE}>)), (s, x) -> named_struct(
        'left', if({flip}, s.left - x.size, s.left),
        'out', concat(s.out, array(named_struct({', '.join(f"'{c}', x.{c}" for c in FIELDS)}, 'up', if({flip}, 1 - x.up, x.up)))))).out"""))
    results.append(ended.select("source", F.explode("held").alias("d")).select("source", "d.*"))
    results.append(ended.where("item is not null").select("source", *[f"item.{c}" for c in FIELDS], F.col("last").alias("up")))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    out = out.withColumn("_place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    out = out.withColumn("copies", F.col("base") + (F.col("_place") <= F.col("whole") + F.col("up")).cast("int"))
    shared = per.select(F.col("source").alias("_source"), "source_size", "target")
    return out.join(shared, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows alike in doc_id, source and size are matched in order of their texts' hashes."""
    keys = ["doc_id", "source", "size"]
    plan = mix(docs, seed)
    plan = plan.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("copies")))).where("copies > 0")
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("_k").alias("_n"), "copies")
    # All columns go along as one struct, so that none can clash.
    columns = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    size = F.when(F.btrim(F.coalesce(F.col("row.text"), F.lit("")), F.lit(common.BLANKS)) == "", 0).otherwise(F.size(F.split(F.btrim("row.text", F.lit(common.BLANKS)), f"[{common.BLANKS}]+"))).cast("long")
    row = row.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), size.alias("size"))
    row = row.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row.text"))))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys] + [F.col("_k") == F.col("_n")]
    taken = row.join(plan, same).withColumn("_copy", F.explode(F.expr("sequence(1, copies)")))
    return taken.select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
