"""Mixing sources to target weights by systematic sampling.

Each document expects target / source size copies. Within its source, expected copies are
prefix-summed in exact decimals from one random offset, and a document is emitted once for each
integer boundary its interval crosses: floor or ceiling of its expectation. Documents are laid out
by size, so the sample follows the size distribution and the words taken stay near the target. A large document's rounding alone could miss it by
much, so a source's large documents (more than 1/HEADS of its words) come first, from the largest on, and each document's expectation is what is left of the
target by what is left of the words: those after it make up for its rounding, up to cap copies.
The prefix sum is distributed: sums of (source, size class, hash) buckets
are added up, then each bucket continues from its base, so a hot source is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, checkpoint, col, fresh, running_base, sub_buckets

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
CAP = 2.0
#: Documents with more than one part in so many of their source's words are settled first, one by one: fewer than so many a source.
HEADS = 256
SEED = 20240607


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """sizes (key_, source, source_size) with weight and target.

    Targets share total times all sizes by weight; none exceeds cap times its source's size, and
    what is over goes to the others by weight. With sources sorted by cap / weight, the level after
    settling the first k sources rises while they are capped and falls after, so the common level
    is the largest of these. One row per source meets in one task, as a rank by name needs anyway.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    zero = F.lit(0.0)
    level = (F.sum("source_size").over(everything) * F.lit(float(total)) - F.coalesce(F.sum("cap").over(before), zero)) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)
    )
    levelled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return levelled.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight"))).drop("cap", "level")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    total: float = TOTAL,
    cap: float = CAP,
    seed: int = SEED,
    narrow: bool = False,
) -> DataFrame:
    """df with size, source_size, target, copies and taken; narrow=True leaves out all but id and source.

    size counts the words of the text (null: 0). A null source is a source of its own, ranked last.
    Long texts are counted whole. Ties in size go by a hash of the id, then the id.
    A source without words has target 0 and no copies. Reruns agree; rows that repeat id and text
    are documents like others. An empty table gives an empty result. Columns of df with the new
    names are replaced, unless they are id, source or text.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    df = df.drop(*[c for c in df.columns if c.lower() in new and c not in (id_col, source_col, text_col)])
    if narrow:
        df = df.select(*map(col, dict.fromkeys([id_col, source_col, text_col])))
    key, cls, sub, mass, base, rate, start, spot = fresh(df, "key_", "class_", "sub_", "mass_", "base_", "rate_", "start_", "spot_")
    bucket = [key, cls, sub]

    def with_size(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                key: F.coalesce(F.concat(F.lit("="), col(source_col)), F.lit("")),
                "size": word_count(col(text_col)),
                spot: F.xxhash64(col(id_col), F.lit(seed)),
            }
        )

    def with_bucket(rows: DataFrame) -> DataFrame:
        return rows.withColumns({cls: F.floor(F.log2(F.col("size") + 1) * 4).cast("int"), sub: F.pmod(col(spot), F.lit(buckets))})

    def step(n: Column) -> Column:
        return (col(rate) * n.cast("decimal(14,0)")).cast("decimal(34,15)")

    def crossed(offset: Column) -> Column:
        return (F.floor(col(start) + step(F.lit(1)) + offset) - F.floor(col(start) + offset)).cast("long")

    place = Window.partitionBy(*bucket).orderBy("size", spot, col(id_col))
    measured = checkpoint(with_size(df).select(*map(col, dict.fromkeys([id_col, source_col])), key, "size", spot))
    buckets = sub_buckets(measured.count(), 32)
    sums = with_bucket(measured).groupBy(*bucket).agg(
        F.sum("size").alias("size"), F.min("size").alias("least"), F.count(F.lit(1)).alias("n"), F.min(col(source_col)).alias("source")
    )
    sums = checkpoint(sums)
    sources = targets(sums.groupBy(key).agg(F.min("source").alias("source"), F.sum("size").alias("source_size")), weights, total, cap)
    sums = checkpoint(sums.join(sources.select(key, "source_size", "target"), key))

    large = sums.where(F.col("least") * HEADS > F.col("source_size"))
    heads = with_bucket(measured).select(*bucket, "size", spot, col(id_col)).join(large.select(*bucket, "source_size", "target"), bucket)
    heads = heads.withColumn("row", F.row_number().over(place))
    heads = heads.groupBy(key).agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sort_array(F.collect_list(F.struct("size", col(cls).alias("cls"), col(sub).alias("sub"), "row")), asc=False).alias("rows"),
    )
    heads = checkpoint(heads.select(key, _heads(_offset(col(key), seed).cast("double"), cap).alias("done")))
    given = heads.select(key, F.explode("done.out").alias("o")).groupBy(key, F.col("o.cls").alias(cls), F.col("o.sub").alias(sub))
    given = given.agg(F.transform(F.sort_array(F.collect_list(F.struct("o.row", "o.copies"))), lambda x: x["copies"]).alias("given"))
    after = heads.select(key, F.col("done.words").alias("words"), F.col("done.target").alias("left"), F.col("done.size").alias("size_left"), F.col("done.at").alias("at"))

    bases = sums.join(given, bucket, "left").join(after, key, "left")
    left, size_left = F.coalesce("left", "target"), F.coalesce(F.col("size_left"), F.col("source_size").cast("double"))
    own = F.when(size_left > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), left / size_left))).otherwise(0.0).cast("decimal(20,15)")
    bases = bases.withColumn(rate, F.when(F.col("given").isNull(), own).otherwise(F.lit(0).cast("decimal(20,15)")))
    bases = bases.withColumn(mass, (col(rate) * F.col("n").cast("decimal(14,0)")).cast("decimal(34,15)"))
    bases = running_base(bases, [key], [cls, sub], mass, base)
    bases = bases.select(*bucket, "source_size", "target", "given", rate, (col(base) + F.coalesce("at", F.lit(0.0)).cast("decimal(34,15)")).cast("decimal(34,15)").alias(base))
    bases = checkpoint(bases)

    rows = measured if narrow else with_size(df)
    kept = [c for c in df.columns if c in (id_col, source_col)] if narrow else df.columns
    (given_,) = fresh(rows, "given_")
    placed = with_bucket(rows).withColumn(start, F.row_number().over(place) - 1).join(bases.withColumnRenamed("given", given_), bucket)
    alone = F.get(col(given_), col(start))
    return (
        placed.withColumn(given_, alone)
        .withColumn(start, (col(base) + step(col(start))).cast("decimal(34,15)"))
        .withColumn("copies", F.coalesce(col(given_), crossed(_offset(col(key), seed))))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*map(col, kept), *new)
    )


def _heads(offset: Column, cap: float) -> Column:
    """Over `rows`, a source's large documents from the largest on, each with the words still to take as its share of the words still there.

    (target, size, words, at, out): what is left of both, and how far the prefix sum has come; the copies of each in `out`.
    """
    at_first = F.struct(
        F.col("target").cast("double").alias("target"), F.col("source_size").cast("double").alias("size"), F.lit(0.0).alias("words"), F.lit(0.0).alias("at"),
        F.array().cast("array<struct<cls:int,sub:int,row:int,copies:bigint>>").alias("out"),
    )

    def one(done: Column, row: Column) -> Column:
        rate = F.when(done["size"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), done["target"] / done["size"]))).otherwise(0.0)
        copies = (F.floor(done["at"] + rate + offset) - F.floor(done["at"] + offset)).cast("long")
        words = copies.cast("double") * row["size"]
        return F.struct(
            (done["target"] - words).alias("target"), (done["size"] - row["size"]).alias("size"), (done["words"] + words).alias("words"), (done["at"] + rate).alias("at"),
            F.concat(done["out"], F.array(F.struct(row["cls"].cast("int").alias("cls"), row["sub"].cast("int").alias("sub"), row["row"].cast("int").alias("row"), copies.alias("copies")))).alias("out"),
        )

    return F.aggregate("rows", at_first, one)


def _offset(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that the source and the seed fix."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11)
    return (bits / F.lit(float(2**53))).cast("decimal(16,15)")


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of a mix as often as the mix takes it; none for an empty table. `columns` may have any names."""
    (nth,) = fresh(mixed, "nth_")
    times = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return mixed.withColumn(nth, F.explode(times)).select(*map(col, columns))
