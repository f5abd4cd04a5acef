"""Writers. Figures are not drawn; the tables behind them are queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.calibration import ordered_places
from lectern.operators.labels import repeated_folds


def by_session(df: DataFrame, path: str, column: str = "session") -> None:
    """JSON lines in one folder for each session."""
    df.repartition(column).write.partitionBy(column).mode("errorifexists").json(path)


def keyed_json(df: DataFrame, path: str, key: str) -> None:
    """A line for each key with its record; keys are sorted within files that follow each other."""
    rest = F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("record")
    df.select(F.col(key).alias("key"), rest).sort("key").write.json(path)


def json_map(df: DataFrame, path: str, key: str) -> None:
    """One JSON object over all files of the folder, one after the other: the keys, sorted and each once, with their records, a line a key."""
    rest = F.to_json(F.struct(*sorted(c for c in df.columns if c != key)))
    lines = df.select(F.col(key).cast("string").alias("key"), rest.alias("record"))
    placed = ordered_places(lines, ["key"])
    head = F.when(F.col("place") == 0, "{").otherwise(", ")
    tail = F.when(F.col("place") + 1 == F.col("among"), "}").otherwise("")
    name = F.to_json(F.struct(F.col("key").alias("k")))  # {"k":"..."}, from which the quoted text is cut
    quoted = F.substring(name, F.lit(6), F.char_length(name) - 6)
    told = placed.select("key", F.concat(head, quoted, F.lit(": "), "record", tail).alias("line"))
    told.sort("key").select("line").write.text(path)


def separated(df: DataFrame, path: str, sep: str = "\t", index: list[str] | None = None) -> None:
    """A table with a header; index: the columns by which rows are ordered and numbered from 0 in a first column without a name."""
    if index:
        placed = ordered_places(df, index)
        df = placed.sort(*index).select(F.col("place").alias("_c0"), *[F.col(c) for c in df.columns])
        df = df.withColumnRenamed("_c0", " ")
    df.write.csv(path, sep=sep, header=True)


def starred(estimate: Column, p: Column, digits: int = 3) -> Column:
    """An estimate as text, with a star each for p below 0.05, 0.01 and 0.001."""
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    return F.concat(F.format_number(estimate, digits), stars)


def regression_table(df: DataFrame, path: str, columns: str | None = None, latex: bool = False) -> None:
    """A regression's table as text: by term the starred estimate and below it the standard error in brackets; by `columns` (a spec) side by side.

    df has term, estimate, se and p; a table has few rows, which is why it becomes one file.
    """
    cell = F.concat(starred(F.col("estimate"), F.col("p")), F.lit(" ("), F.format_number("se", 2), F.lit(")"))
    long = df.select("term", (F.col(columns) if columns else F.lit("estimate")).alias("column"), cell.alias("cell"))
    wide = long.groupBy("term").pivot("column").agg(F.first("cell")).na.fill("").sort("term")
    if not latex:
        wide.coalesce(1).write.csv(path, sep="\t", header=True)
        return
    line = F.concat(F.concat_ws(" & ", *wide.columns), F.lit(" \\\\"))
    head = df.sparkSession.createDataFrame([(0, " & ".join(wide.columns) + " \\\\ \\hline")], "at int, value string")
    head.unionAll(wide.select(F.lit(1), F.regexp_replace(line, "([_%#])", r"\\$1"))).coalesce(1).sortWithinPartitions("at", "value").select("value").write.text(path)


def splits(df: DataFrame, path: str, key: str, folds: int, test_share: float) -> None:
    """JSON lines by fold and split (train or test), folder by folder: each row once a fold, drawn for each anew."""
    drawn = repeated_folds(df, key, folds, test_share)
    each = df.join(drawn, key).withColumn("split", F.when(F.col("test") == 1, "test").otherwise("train")).drop("test")
    each.write.partitionBy("fold", "split").mode("errorifexists").json(path)


def vectors(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def coefficients(df: DataFrame, path: str) -> None:
    """A regression's table (term, estimate, ...)."""
    df.coalesce(1).write.csv(path, header=True)
