"""Document fingerprints: 64-bit SimHash, and permuted block tables to find close ones.

A document's terms are its pairs of neighbouring words (and the last word alone); each occurrence
votes once, so a term weighs as often as it occurs. Bit j is set where the hashes of most votes have
it. Votes are summed two bits to a long, in lanes of 32 bits, by built-in aggregates.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, checkpoint, col, fresh

BITS = 64
LANES = 0x0000000100000001
#: Bits that near fingerprints may differ in, and how many blocks more than that a fingerprint is cut into.
RADIUS, SPARE = 3, 3
#: Cells of about equal counts, each cut into ranges of equal width; the ranges bound the broadcast.
CELLS, MOST_RANGES, ROWS_A_RANGE = 64, 65_536, 2_000


def terms(text: Column) -> Column:
    """The hashes of a text's terms, one for each occurrence; none for a text without words."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")
    # Bound as a variable of an outer lambda, the words are split once, not once for each word.
    return F.transform(F.array(words), lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1))))[0]


def vote_sums(term: Column) -> dict[str, Column]:
    """The aggregates that simhash() reads: votes in all, and for the bits j and j + 32."""
    sums = {f"v{j}": F.sum(F.shiftrightunsigned(term, j).bitwiseAND(F.lit(LANES))) for j in range(32)}
    return {"v": F.count(term)} | sums


def simhash(prefix: str = "") -> Column:
    """The fingerprint as a long; 0 without votes."""
    total, out = F.col(prefix + "v"), F.lit(0).cast("long")
    for j in range(32):
        lanes = F.coalesce(F.col(f"{prefix}v{j}"), F.lit(0))
        low, high = lanes.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(lanes, 32)
        for bit, votes in ((j, low), (j + 32, high)):
            mask = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(votes * 2 > total, F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint as a long), one row per row of df; a null text counts as empty, whose fingerprint is 0.

    Long texts are read whole; rows that repeat id and text are rows of their own, as are those with null ids; an empty table gives an empty result. df may have columns of any name.
    """
    row, term = fresh(df, "row_", "term_")
    numbered = df.select(col(id_col), F.monotonically_increasing_id().alias(row), terms(col(text_col)).alias(term))
    votes = numbered.select(col(id_col), col(row), F.explode_outer(col(term)).alias(term)).groupBy(col(id_col), col(row))
    return votes.agg(*[c.alias(n) for n, c in vote_sums(col(term)).items()]).select(col(id_col), simhash().alias("fingerprint"))


def _near(values: DataFrame, radius: int, spare: int) -> DataFrame:
    """The ordered pairs (a, b, distance) of different values within the radius, each once.

    The 64 bits are cut into radius + spare blocks. Fingerprints within the radius agree on at least `spare` whole
    blocks, so each choice of `spare` blocks is a table keyed by their bits. A pair counts in the table of the first blocks
    that it agrees on: between these, every block that isn't chosen differs. Distance and blocks are conditions of the
    join, which thus gives no other row.
    """
    n = radius + spare
    edges = [BITS * i // n for i in range(n + 1)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    blocks = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:], strict=False)]
    long = lambda m: F.lit(signed(m)).cast("long")
    tables = []
    for t, chosen in enumerate(combinations(range(n), spare)):
        passed = [blocks[i] for i in range(chosen[-1]) if i not in chosen]
        passed += [0] * (radius - len(passed))
        key = F.col("fingerprint").bitwiseAND(long(sum(blocks[i] for i in chosen)))
        tables.append(F.struct(F.lit(t).alias("t"), key.alias("k"), *[long(m).alias(f"m{i}") for i, m in enumerate(passed)]))
    spread = values.select("fingerprint", F.explode(F.array(*tables)).alias("e")).select("fingerprint", "e.*")
    left = spread.withColumnRenamed("fingerprint", "a")
    right = spread.select(F.col("fingerprint").alias("b"), "t", "k")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    wanted = (F.col("a") != F.col("b")) & (F.bit_count(apart) <= radius)
    for i in range(radius):
        wanted = wanted & ((F.col(f"m{i}") == 0) | (apart.bitwiseAND(F.col(f"m{i}")) != 0))
    return left.join(right, ["t", "k"]).where(wanted).select("a", "b", F.bit_count(apart).alias("distance"))


def near_pairs(prints: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """All pairs (a, b, distance), a < b, of different values of `fingerprint` within the radius.

    Documents with one fingerprint enter once, whatever their texts' length; null fingerprints take no part; an empty table gives an empty result.
    Other columns of prints play no part.
    """
    values = prints.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
    return _near(values, radius, spare).where(F.col("a") < F.col("b"))


def with_near_counts(df: DataFrame, fingerprint: str = "fingerprint", radius: int = RADIUS, spare: int = SPARE, out: str = "near_fingerprints") -> DataFrame:
    """df with `out`: how many other fingerprints of df are within the radius of the row's own.

    fingerprint is text as by as_text(). Rows with one fingerprint have one count and are no neighbours of each other; a null
    fingerprint has 0; an empty table gives an empty result. df may have columns of any name, a column `out` is replaced. It is read twice. Pairs are
    counted where they are found and aren't shuffled; comparing is work with the square of the fingerprints that share a block table's key.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == out.lower() and c != fingerprint])
    value, count = fresh(df, "value_", "count_")
    named = df.withColumn(value, F.conv(col(fingerprint), 16, -10).cast("long"))
    values = named.select(col(value).alias("fingerprint")).where("fingerprint is not null").distinct()
    # Stored, so that the join below reads two plain exchanges, of which Spark can split a hot fingerprint's.
    counts = checkpoint(_near(values, radius, spare).groupBy("a").agg(F.count(F.lit(1)).alias(count)).withColumnRenamed("a", value))
    return named.join(counts, value, "left").select(*map(col, df.columns), F.coalesce(col(count), F.lit(0)).cast("long").alias(out))


def _ranges(df: DataFrame, key: Column) -> Column:
    """The number of a range of keys, higher for higher keys, with about equally many rows each."""
    n = df.count()
    per_cell = max(1, min(MOST_RANGES, -(-n // ROWS_A_RANGE)) // CELLS)
    quantiles = [i / CELLS for i in range(CELLS + 1)]
    edges = df.agg(F.percentile_approx(key, quantiles, 10_000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    if len(edges) < 2:
        return F.lit(0)
    inner = F.array(*[F.lit(e).cast("long") for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<bigint>")
    cell = F.size(F.filter(inner, lambda e: e <= key))
    bounds = F.array(*[F.lit(e).cast("long") for e in edges])
    low, high = F.get(bounds, cell), F.get(bounds, cell + 1)
    part = (key.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double")) * per_cell
    return cell * per_cell + F.greatest(F.lit(0), F.least(F.lit(per_cell - 1), F.floor(part).cast("int")))


def with_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprints of each text and of its edited text, and their likeness.

    Edited: the last floor(n / 3) code points are replaced by the first as many of the next document
    by descending id; after the last comes the first. id_col is integral; null ids come last, rows
    with equal ids are ordered by their texts' hash, a null text counts as empty. A table of one row
    is its own next; an empty table gives an empty result. Long texts are read whole. Further columns of df, whatever their names, play no part. Ranges of ids are windows of their own; the head of each range is also sent
    to the range before it.
    """
    key = F.coalesce(col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(col(text_col), F.lit(""))
    base = df.select(col(id_col).alias("id"), key.alias("key"), text.alias("text"))
    span = _ranges(df.select(col(id_col).alias("i")), F.coalesce(F.col("i").cast("long"), F.lit(-(1 << 63))))
    keyed = df.select(col(id_col).alias("i")).select(F.coalesce(F.col("i").cast("long"), F.lit(-(1 << 63))).alias("i"))
    heads = keyed.withColumn("at", span).groupBy("at").agg(F.max("i").alias("head"))
    down = Window.orderBy(F.col("at").desc())
    last = F.min("at").over(Window.partitionBy(F.lit(1)))
    heads = heads.select("head", F.coalesce(F.lag("at").over(down), last).alias("to"))
    own = base.withColumns({"i": F.col("key"), "ghost": F.lit(False)}).withColumn("at", span).drop("i")
    ghosts = base.join(F.broadcast(heads), F.col("key") == F.col("head")).select("id", "key", "text", F.lit(True).alias("ghost"), F.col("to").alias("at"))
    order = [F.col("ghost"), F.col("key").desc(), F.xxhash64("text"), F.col("text")]
    walk = Window.partitionBy("at").orderBy(*order)
    rows = own.unionByName(ghosts).withColumns({"n": F.row_number().over(walk), "next": F.lead("text").over(walk)})
    chars = F.char_length("text")
    cut = F.floor(chars / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    texts = rows.select(
        "at", "n", "ghost", "id", chars.cast("long").alias("n_chars"), F.col("text"), F.when(~F.col("ghost"), edited).alias("edited")
    )
    both = texts.select(
        "at", "n", "ghost", "id", "n_chars",
        F.when(F.col("edited").isNotNull(), F.sha2(F.encode("edited", "UTF-8"), 256)).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("e"), terms(F.col("text")).alias("t")), F.struct(F.lit(1).alias("e"), terms(F.col("edited")).alias("t")))).alias("s"),
    )
    # What a row carries is part of the key, so that only longs are aggregated, by hashing and without a sort.
    carried = ["at", "n", "ghost", "id", "n_chars", "edited_sha256"]
    votes = both.select(*carried, "s.e", F.explode_outer("s.t").alias("t"))
    prints = votes.groupBy(*carried, "e").agg(*[c.alias(n) for n, c in vote_sums(F.col("t")).items()]).select(*carried, "e", simhash().alias("f"))
    paired = prints.groupBy(*carried).agg(F.max(F.when(F.col("e") == 0, F.col("f"))).alias("f"), F.max(F.when(F.col("e") == 1, F.col("f"))).alias("g"))
    follow = Window.partitionBy("at").orderBy("n")
    return (
        paired.withColumn("h", F.lead("f").over(follow))
        .where(~F.col("ghost"))
        .select(
            F.col("id").alias(id_col),
            "n_chars",
            "edited_sha256",
            as_text(F.col("f")).alias("fingerprint"),
            as_text(F.col("g")).alias("edited_fingerprint"),
            likeness(F.col("f"), F.col("g")).alias("near_edited"),
            likeness(F.col("f"), F.col("h")).alias("near_next"),
        )
    )
