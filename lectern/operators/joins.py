"""Joins with a rule for several matches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.storage import checkpoint

#: A dimension of at most so many rows is broadcast; larger ones meet by cells of the key.
SMALL = 10_000


def interval_last(facts: DataFrame, terms: DataFrame, on: str, at: str, start: str, end: str, pos: str, take: list[str], row: list[str]) -> DataFrame:
    """facts with the fields `take` of the last term (by pos) of the same `on` that holds `at`, ends included; nulls where none does."""
    t = terms.select(F.col(on), F.col(start).alias("lo_"), F.col(end).alias("hi_"), F.col(pos).alias("pos_"), *take)
    hit = facts.select(*row, on, at).join(t, on).where(F.col(at).between(F.col("lo_"), F.col("hi_")))
    best = hit.groupBy(*row).agg(F.max_by(F.struct(*take), "pos_").alias("b")).select(*row, *[F.col(f"b.{c}").alias(c) for c in take])
    return facts.join(best, row, "left")


def overwrite(left: DataFrame, right: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """left with the columns' values of right where it has any."""
    r = right.select(on, *[F.col(c).alias(f"{c}_new") for c in columns])
    rest = [c for c in left.columns if c not in columns]
    return left.join(r, on, "left").select(*rest, *[F.coalesce(F.col(f"{c}_new"), F.col(c)).alias(c) for c in columns])


def prefer_last(tables: list[DataFrame], key: str) -> DataFrame:
    """The union by key; of rows with one key that of the last table."""
    both = None
    for i, df in enumerate(tables):
        some = df.withColumn("prio_", F.lit(i))
        both = some if both is None else both.unionByName(some)
    rest = [c for c in both.columns if c not in (key, "prio_")]
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), "prio_").alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in rest])


def similarity(a: Column, b: Column) -> Column:
    """100 for equal texts, less for each edit, by the longer one's length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


#: Letters of a gram, and the likeness (per cent) above which grams must be shared.
GRAM, LIKE = 2, 60.0


def _grams(names: DataFrame, name: str) -> DataFrame:
    """names with gram, a row for each pair of neighbouring letters, numbered where it comes again; of a shorter name itself."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(name) - GRAM + 1, F.lit(1)))
    pairs = F.transform(spots, lambda i: F.substr(F.col(name), i, F.lit(GRAM)))
    return names.withColumn("gram", F.explode(F.transform(pairs, lambda g, i: F.concat_ws("#", g, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda x: x == g)).cast("string")))))


def _with_prefix(names: DataFrame, block: list[str], name: str, found: DataFrame, like: float) -> DataFrame:
    """(block, name, gram): for each name the rarest of its grams, so many that two names of the given likeness have one in common; '' for short ones.

    Two names, the longer of m letters, that differ by e edits share m - 1 - 2 * e grams; so of the grams in any fixed order the first 2 * e + 1 of the
    longer hold a common one, and of one with d letters less the first 2 * e + 1 - d. Where m - 1 <= 2 * e both are short and meet by the empty gram.
    """
    n, part = F.length(name), 1 - like / 100
    less = F.sequence(F.lit(0), F.ceil(n * part / (1 - part)).cast("int"))
    most = F.array_max(F.transform(less, lambda d: GRAM * F.floor((n + d) * part + 1e-9) + 1 - d))
    order = Window.partitionBy(*block, name).orderBy("found_", "gram")
    rare = _grams(names, name).join(found.hint("merge"), [*block, "gram"]).withColumn("at_", F.row_number().over(order)).where(F.col("at_") <= most)
    short = names.where(n * (1 - GRAM * part) <= GRAM - 1 + 1e-9)
    return rare.select(*block, name, "gram").unionByName(short.select(*block, name, F.lit("").alias("gram")))


def like_pairs(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, like: float = LIKE) -> DataFrame:
    """(block, a, b): candidates among which are all pairs of a block with similarity() of `like` or more, 50 or more.

    By block the cheaper of two ways: names that share one of their rarest letter pairs, or, where these are common, all pairs of lengths that can be alike.
    """
    lefts, rights = left.select(*block, a).where(F.col(a).isNotNull()).distinct(), right.select(*block, b).where(F.col(b).isNotNull()).distinct()
    found = _grams(lefts, a).select(*block, "gram").unionAll(_grams(rights, b).select(*block, "gram")).groupBy(*block, "gram").agg(F.count(F.lit(1)).alias("found_"))
    one, two = _with_prefix(lefts, block, a, found, like), _with_prefix(rights, block, b, found, like)
    count = lambda df, name, by: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    meet = count(one, "l_", [*block, "gram"]).join(count(two, "r_", [*block, "gram"]), [*block, "gram"]).groupBy(*block).agg(F.sum(F.col("l_") * F.col("r_")).alias("meet_"))
    whole = count(lefts, "l_", block).join(count(rights, "r_", block), block).join(meet, block, "left")
    cheap = checkpoint(whole.select(*block, (2 * F.coalesce("meet_", F.lit(0)) <= F.col("l_") * F.col("r_")).alias("by_gram_")))
    fits = F.least(F.length(a), F.length(b)) >= F.lit(like / 100 - 1e-9) * F.greatest(F.length(a), F.length(b))
    by_gram = one.join(cheap.where("by_gram_").drop("by_gram_"), block).join(two.hint("merge"), [*block, "gram"]).where(fits).select(*block, a, b).distinct()
    by_length = lefts.join(cheap.where("not by_gram_").drop("by_gram_"), block).join(rights.hint("merge"), block).where(fits)
    return by_gram.unionByName(by_length)


#: Names that are compared at a time, of the left and of the right table, and the signs of a right name that fit a word of bits.
LEFTS, RIGHTS, BITS = 4096, 2048, 64


def nearest(lefts: list[str], rights: list[str]) -> Iterator[tuple[int, float]]:
    """For each of lefts the place of the first most similar one of rights, of at most BITS signs each, and their similarity().

    A column of the table of edits is a word of bits for each right name (Myers, Hyyro). Lefts are sorted, so that only the signs after what one shares with
    the one before are worked off, of the first BITS.
    """
    import numpy as np

    size = np.array([len(r) for r in rights], np.int32)
    places: dict[str, list[int]] = {}
    for i, r in enumerate(rights):
        for j, c in enumerate(r):
            places.setdefault(c, [0] * len(rights))[i] |= 1 << j
    equal = {c: np.array(x, np.uint64) for c, x in places.items()}
    last = np.array([1 << n >> 1 for n in size.tolist()], np.uint64)
    one, none, empty = np.uint64(1), np.zeros(len(rights), np.uint64), size == 0
    states, before = [(~none, none, size)], ""
    for a in lefts:
        shared = 0
        while shared < min(len(a), len(before), len(states) - 1) and a[shared] == before[shared]:
            shared += 1
        del states[shared + 1 :]
        up, down, edits = states[-1]
        for at in range(shared, len(a)):
            x = equal.get(a[at], none) | down
            diagonal = ((x & up) + up ^ up) | x
            less, more = up & diagonal, down | ~(up | diagonal)
            edits = edits + ((more & last != 0) | empty) - (less & last != 0)
            more = more << one | one
            up, down = less << one | ~(more | diagonal), more & diagonal
            if at < BITS:
                states.append((up, down, edits))
        before = a
        likeness = 100.0 * (1 - edits / np.maximum(np.maximum(size, len(a)), 1))
        best = int(likeness.argmax())
        yield best, float(likeness[best])


def _pieces(names: DataFrame, block: list[str], name: str, size: int, piece: str, all_of: str) -> DataFrame:
    """(block, piece, all_of, name): the names of a block as sorted arrays of about `size`, numbered below all_of."""
    sizes = names.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(all_of))
    dealt = names.join(sizes.hint("merge"), block).withColumn(piece, F.pmod(F.xxhash64(name), F.col(all_of)).cast("int"))
    return dealt.groupBy(*block, piece, all_of).agg(F.array_sort(F.collect_list(name)).alias(name))


def _best_of_all(lefts: DataFrame, rights: DataFrame, block: list[str], a: str, b: str) -> DataFrame:
    """(block, a, b, score): for each name of lefts the best in each piece of rights (names of at most BITS signs). Pieces meet pieces of their block, in tasks
    of a few pairs of pieces each; what a task holds does not grow with the tables."""
    one = checkpoint(_pieces(lefts, block, a, LEFTS, "left_", "lefts_"))
    two = checkpoint(_pieces(rights, block, b, RIGHTS, "right_", "rights_"))
    numbers = two.select(*block, "right_")
    n = one.select(*block, "left_").hint("merge").join(numbers, block).count()
    # The shuffle by number keeps AQE from putting many pairs of small arrays and much work into one task.
    meet = one.join(numbers.hint("merge"), block).join(two.hint("merge"), [*block, "right_"]).select(*block, a, b).repartition(max(1, min(10_000, n // 2)))
    kinds = T.StructType([*[meet.schema[c] for c in block], lefts.schema[a], rights.schema[b], T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ls, rs = (batch.column(batch.num_columns - k)[i].as_py() for k in (2, 1))
                found = list(nearest(ls, rs))
                same = [batch.column(k).take(pa.array([i] * len(ls), pa.int64())) for k in range(len(block))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(ls, pa.string()), pa.array([rs[k] for k, _ in found], pa.string()), pa.array([x for _, x in found])], [*block, a, b, "score"])

    return meet.mapInArrow(run, kinds)


def best_match(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, least: float = 0.0) -> DataFrame:
    """For each row of left the most similar b within its block, the first by name on ties, with a score of `least` or more: (left's columns, b, score).

    With `least` of LIKE per cent or more among like_pairs(), else among all pairs of a block, piece by piece: work with the product of a block's different
    names, memory without. Equal rows of left are matched once and come out as often as they are there; rows with a null name or block, and null b, match
    nothing. No names are broadcast: short ones shrink so well in a shuffle that AQE would take large tables for small ones.
    """
    score = similarity(F.col(a), F.col(b))
    if least >= LIKE:
        told = like_pairs(left, right, block, a, b, least).withColumn("score", score)
    else:
        lefts, rights = (df.select(*block, c).where(F.col(c).isNotNull()).dropna(subset=block).distinct() for df, c in ((left, a), (right, b)))
        short = F.length(b) <= BITS
        told = _best_of_all(lefts, rights.where(short), block, a, b)
        told = told.unionByName(lefts.join(rights.where(~short).hint("merge"), block).withColumn("score", score))
    best = told.where(F.col("score") >= least).groupBy(*block, a).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(b).alias("b"))).alias("best_"))
    return left.join(best.hint("merge"), [*block, a]).select(*left.columns, F.col("best_.b").alias(b), (-F.col("best_.s")).alias("score"))


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join, after a check that neither side repeats a key; the check is part of the plan."""
    def unique(df: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*on))
        return df.withColumn("n_", n).withColumn("n_", F.when(F.col("n_") > 1, F.raise_error(F.lit(f"{name} repeats a key"))).otherwise(F.col("n_"))).where("n_ = 1").drop("n_")

    return unique(left, "left").join(unique(right, "right"), on)


def combinations(df: DataFrame, key: str, take: list[str], n: int) -> DataFrame:
    """All n rows of a small table in the order of a unique key, one row each, the columns `take` numbered from 1; grows with rows ** n."""
    if df.limit(SMALL + 1).count() > SMALL:
        raise ValueError(f"combinations are for tables of at most {SMALL} rows")
    side = lambda i: df.select(F.col(key).alias(f"key{i}_"), *[F.col(c).alias(f"{c}{i}") for c in take])
    out = side(1)
    for i in range(2, n + 1):
        out = out.join(F.broadcast(side(i)), F.col(f"key{i - 1}_") < F.col(f"key{i}_"))
    return out.select(*[f"{c}{i}" for i in range(1, n + 1) for c in take])


def one_edit_neighbours(words: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """Pairs (word, other, n_other) at edit distance 1.

    Words at distance 1 share a form with at most one letter left out, so they meet by an equi-join on those
    forms; no pair of the vocabulary is compared otherwise.
    """
    spots = F.sequence(F.lit(0), F.length(word))
    # Forms meet by their hashes, so a long word's take no more room each than a short one's.
    forms = F.transform(spots, lambda i: F.xxhash64(F.concat(F.substr(F.col(word), F.lit(1), F.greatest(i - 1, F.lit(0))), F.substr(F.col(word), i + 1))))
    some = words.select(word, n, F.explode(F.array_distinct(F.concat(F.array(F.xxhash64(word)), forms))).alias("form"))
    left, right = some.select(word, "form"), some.select(F.col(word).alias("other"), F.col(n).alias("n_other"), "form")
    return left.join(right, "form").where(F.levenshtein(word, "other") == 1).select(word, "other", "n_other").distinct()


def _place(x: Column, kind: T.DataType) -> Column:
    return (F.unix_date(x) if isinstance(kind, T.DateType) else x).cast("double")


def in_range(facts: DataFrame, ranges: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """facts with each half-open range that holds `at` (numbers, dates or times).

    A small dimension is broadcast after its size is checked. The ranges of a larger one are laid on cells as wide as a range is on average, so
    on few cells each in all, and meet the facts of a cell by an equi-join. Null and empty ranges hold nothing.
    """
    holds = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    if ranges.limit(SMALL + 1).count() <= SMALL:
        return facts.join(F.broadcast(ranges), holds)
    low, high = (_place(F.col(c), ranges.schema[c].dataType) for c in (start, end))
    some = ranges.where(F.col(start) < F.col(end))
    step = some.agg(F.avg(high - low)).first()[0] or 1.0
    cell = lambda x: F.floor(x / F.lit(float(step)))
    laid = some.withColumn("cell_", F.explode(F.sequence(cell(low), cell(high))))
    return facts.withColumn("cell_", cell(_place(F.col(at), facts.schema[at].dataType))).join(laid, "cell_").where(holds).drop("cell_")
