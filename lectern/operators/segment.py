"""Sentences to groups, blocks and contexts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import token_count

BLOCK_TOKENS = 375


def rejoin(sents: DataFrame, key: str, pos: str, text: str, need_period: bool = True) -> DataFrame:
    """Sentences that were split by mistake, glued: (key, grp, text, n_sents).

    One is glued to the one before if that ends in a period (need_period) and it begins with a lower-case letter,
    a digit, $ or %. Whether one is glued depends on its neighbour only, so a running count of the breaks numbers the groups.
    """
    order = Window.partitionBy(key).orderBy(pos)
    some = sents.where(F.col(text) != "")
    glued = F.col(text).rlike(r"^[\p{Ll}0-9$%]") & F.lag(pos).over(order).isNotNull()
    if need_period:
        glued = glued & F.coalesce(F.lag(text).over(order).endswith("."), F.lit(False))
    marked = some.withColumn("glued", glued)
    grouped = marked.withColumn("grp", F.sum(F.when(F.col("glued"), 0).otherwise(1)).over(order) - 1)
    return (
        grouped.groupBy(key, "grp")
        .agg(F.array_sort(F.collect_list(F.struct(pos, text))).alias("s"))
        .select(key, F.col("grp").cast("long"), F.array_join(F.transform("s", lambda x: x[text]), " ").alias("text"), F.size("s").cast("long").alias("n_sents"))
    )


def rejoin_arrays(sents: DataFrame, key: str, pos: str, tokens: str, *others: str) -> DataFrame:
    """Tokenised sentences that were split by mistake, glued in lock step: (key, grp, tokens, *others).

    One is glued to the one before if that one's last token is a period and its own first is in lower case, a number, $ or %.
    Sentences without tokens are left out.
    """
    order = Window.partitionBy(key).orderBy(pos)
    some = sents.where(F.size(tokens) > 0)
    first, last = F.get(tokens, F.lit(0)), F.element_at(tokens, -1)
    goes_on = first.rlike(r"^(?=.*\p{Ll})[^\p{Lu}\p{Lt}]*$") | first.rlike(r"^\p{Nd}+$") | first.isin("$", "%")
    glued = goes_on & F.coalesce(F.lag(last).over(order) == ".", F.lit(False))
    grouped = some.withColumn("glued", glued).withColumn("grp", (F.sum(F.when(F.col("glued"), 0).otherwise(1)).over(order) - 1).cast("long"))
    told = grouped.groupBy(key, "grp").agg(F.sort_array(F.collect_list(F.struct(pos, tokens, *others))).alias("s"))
    return told.select(key, "grp", *[F.flatten(F.col("s")[c]).alias(c) for c in (tokens, *others)])


def packed(lengths: Column, most: int = BLOCK_TOKENS) -> Column:
    """Blocks of sentences, as an array of (first, n, tokens): a block takes sentences until the next would exceed `most` tokens.

    The fold emits a block when the next begins, so its array grows by blocks, not by sentences.
    """
    kind = "array<struct<first:int,n:int,tokens:bigint>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("tokens"))
    block = lambda acc: F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n"), acc["tokens"].alias("tokens"))).cast(kind)

    def step(acc: Column, n: Column) -> Column:
        over = (acc["n"] > 0) & (acc["tokens"] + n > most)
        return F.struct(
            F.when(over, F.concat(acc["done"], block(acc))).otherwise(acc["done"]).alias("done"), F.when(over, acc["first"] + acc["n"]).otherwise(acc["first"]).alias("first"),
            F.when(over, 1).otherwise(acc["n"] + 1).alias("n"), F.when(over, n).otherwise(acc["tokens"] + n).cast("long").alias("tokens"),
        )

    return F.aggregate(lengths, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], block(acc))).otherwise(acc["done"]))


def pack(lengths: Column, most: int = BLOCK_TOKENS) -> Column:
    """The block of each sentence, as an array."""
    return F.flatten(F.transform(packed(lengths, most), lambda b, i: F.array_repeat(i, b["n"])))


def blocks(df: DataFrame, key: str, sents: Column, most: int = BLOCK_TOKENS) -> DataFrame:
    """(key, block, n_tokens, text): sentences packed in order, speeches of any length; no row leaves its partition."""
    counted = df.select(key, F.filter(sents, lambda s: s != "").alias("sents"))
    rows = counted.select(key, "sents", packed(F.transform("sents", token_count), most).alias("blocks"))
    rows = rows.select(key, "sents", F.posexplode("blocks").alias("block", "b"))
    text = F.array_join(F.slice("sents", F.col("b.first") + 1, F.col("b.n")), " ")
    return rows.select(key, F.col("block").cast("long"), F.col("b.tokens").alias("n_tokens"), text.alias("text"))


def contexts(sents: Column, hits: Column, reach: int = 3) -> Column:
    """For each sentence number in hits the sentences up to `reach` away, joined."""
    low = lambda i: F.greatest(i - reach, F.lit(0))
    return F.transform(hits, lambda i: F.struct(i.alias("center"), F.array_join(F.slice(sents, low(i) + 1, i + reach + 1 - low(i)), " ").alias("text")))


def chunks(tokens: Column, pieces: Column) -> Column:
    """Tokens in that many pieces; the last takes the remainder."""
    size = F.floor(F.size(tokens) / pieces).cast("int")
    last = lambda i: i == pieces - 1
    return F.transform(
        F.sequence(F.lit(0), pieces - 1), lambda i: F.slice(tokens, i * size + 1, F.when(last(i), F.size(tokens) - i * size).otherwise(size))
    )


def suppress(scored: Column, reach: int = 5) -> Column:
    """Of structs (p, num) those kept: by falling p, larger num first on ties, none within `reach` of one kept."""
    order = F.reverse(F.array_sort(scored))
    none = F.slice(order, 1, 0)
    return F.aggregate(
        order, none, lambda kept, x: F.when(F.exists(kept, lambda k: F.abs(k["num"] - x["num"]) <= reach), kept).otherwise(F.concat(kept, F.array(x)))
    )


def president_lines(lines: DataFrame, key: str, pos: str, kind: str) -> DataFrame:
    """Lines that a president speaks. kind: 1 a president begins, 2 someone else, 0 goes on. All lines where none is marked."""
    run = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.last(F.when(F.col(kind) > 0, F.col(kind)), ignorenulls=True).over(run), F.lit(1))
    any_marked = F.max(kind).over(Window.partitionBy(key))
    return lines.withColumn("state", state).withColumn("marked", any_marked).where("marked = 0 or state = 1").drop("state", "marked")


def islands(periods: DataFrame, key: list[str], period: str) -> DataFrame:
    """Valid periods in blocks: an isolated one is dropped and ends a block, a gap alone does not."""
    order = Window.partitionBy(*key).orderBy(period)
    near = (F.col(period) - F.lag(period).over(order) == 1) | (F.lead(period).over(order) - F.col(period) == 1)
    marked = periods.withColumn("near", F.coalesce(near, F.lit(False)))
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(period).desc()))
    marked = marked.withColumn("brk", F.when(~F.col("near") & F.lag(period).over(order).isNotNull() & (last > 1), 1).otherwise(0))
    return marked.withColumn("block", F.sum("brk").over(order)).where("near").drop("near", "brk")
