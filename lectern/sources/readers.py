"""Readers with explicit schemas. Paths may be globs; .gz is read as it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import zero_pad

SPEECH = "id string, session int, year int, month int, day int, date string, chamber string, ext string, speaker string, bioguide string, text string"
DESCRIPTION = (
    "speech_id string, chamber string, date string, line_num string, speaker string, first_name string, last_name string, state string, gender string, "
    "line_start string, line_end string, file string, char_count string, word_count string"
)
SPEAKER_MAP = "speaker_id string, speech_id string, last_name string, first_name string, chamber string, state string, gender string, party string, district string, voting string"
PAGE = (
    "id string, header struct<chamber:string,year:string,month:string,day:string,extension:string>, "
    "content array<struct<kind:string,speaker:string,speaker_bioguide:string,text:string,turn:int>>"
)
TOKENIZED = "infile string, id string, sents array<string>, tokens array<array<string>>"
PARSED = "id string, tokens array<array<string>>, lemmas array<array<string>>, tags array<array<string>>, deps array<array<string>>, heads array<array<int>>"
LEGISLATORS = "id struct<bioguide:string>, name struct<last:string,first:string>, bio struct<gender:string>, terms array<struct<start:string,end:string,party:string,state:string>>"
METADATA = "map<string, struct<date:string,year:string,month:string,day:string,speaker_id:string,speaker:string,last_name:string,first_name:string,chamber:string,gender:string,state:string,party:string>>"
#: A day whose files are corrupt.
CORRUPT_DAY = "18940614"


def _windows_marks() -> tuple[str, str]:
    """The signs that Windows-1252 has where ISO-8859-1 has control codes."""
    codes = [i for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    return "".join(map(chr, codes)), bytes(codes).decode("cp1252")


def from_windows(df: DataFrame) -> DataFrame:
    """A table that was read as ISO-8859-1 though its files are Windows-1252, which Spark's readers don't know by name."""
    wrong, right = _windows_marks()
    return df.select(*[F.translate(c, wrong, right).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def pipe_speeches(spark: SparkSession, path: str) -> DataFrame:
    """(speech_id, text): the first field is the id, further pipes in the text become spaces; the header goes."""
    lines = from_windows(spark.read.csv(path, sep="\u0001", quote="", schema="line string", encoding="iso-8859-1"))
    parts = F.split("line", r"\|")
    return lines.select(parts[0].alias("speech_id"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ").alias("text")).where("speech_id <> 'speech_id'")


def without_corrupt_day(speeches: DataFrame, dates: DataFrame) -> DataFrame:
    """Speeches with their dates, but for the corrupt day."""
    return speeches.join(dates.select("speech_id", "date"), "speech_id").where(F.col("date") != CORRUPT_DAY)


def pipe_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Speech descriptions or speaker maps."""
    return from_windows(spark.read.csv(path, sep="|", header=True, quote="", schema=schema, encoding="iso-8859-1"))


def blank_to(df: DataFrame, column: str, sentinel: str = "Unknown") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isNull() | (F.trim(column) == ""), sentinel).otherwise(F.col(column)))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each item of the nested page records."""
    return explode_pages(spark.read.json(path, schema=PAGE, multiLine=True))


def explode_pages(raw: DataFrame) -> DataFrame:
    """Speeches by someone named, with the item's place as suffix of the id."""
    items = raw.select("id", "header", F.posexplode("content").alias("pos", "item"))
    named = items.where((F.col("item.kind") == "speech") & (F.col("item.speaker").isNotNull() | F.col("item.speaker_bioguide").isNotNull()))
    return named.select(
        F.concat_ws("_", "id", zero_pad(F.col("pos"), 4)).alias("id"), F.col("header.chamber").alias("chamber"),
        F.concat("header.year", F.lpad("header.month", 2, "0"), F.lpad("header.day", 2, "0")).alias("date"),
        F.nullif(F.col("item.speaker"), F.lit("None")).alias("speaker"), F.col("item.speaker_bioguide").alias("bioguide"), F.col("item.text").alias("text"),
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def json_map(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    """The entries of files that each hold one JSON object: (key, value)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", schema)).alias("key", "value"))


def separated(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, schema=schema)


def logits(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """Predictions by segment: the segment is named in a column, never by a line's place."""
    return separated(spark, path, "segment_id string, predicted int, " + ", ".join(f"{c} double" for c in classes))


def numbered_lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(file, place, value): the lines of text files with their numbers from 0 in their file; a header is left out and not counted.

    A large file is read in blocks by several tasks. Within a block rows keep their order, so a line's number is its place in the block and the lines
    of the file's blocks before it; of those only counts meet, a row a block, and these go to the lines.
    """
    some = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    blocks = some.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    lines = some.join(F.broadcast(starts), ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("start") - int(header)).alias("place"), "value")
    return lines.where("place >= 0") if header else lines


def zipped(left: DataFrame, right: DataFrame, name: Column) -> DataFrame:
    """(name, place, left, right): lines of two sets of files side by side, by the file's name and the line's number; name is an expression of file.

    Grouping sorts by its first column: the places tell lines apart at once, the names hardly any. A line without its partner, as where one file is shorter than the other, ends the query with an error that names it.
    """
    one = lambda df, side: df.select(name.alias("name"), "place", F.lit(side).alias("side"), "value")
    both = one(left, 0).unionAll(one(right, 1)).groupBy("place", "name").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("side") == 0, F.col("value"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("right")
    )
    said = F.concat(F.lit("line "), F.col("place").cast("string"), F.lit(" of "), F.coalesce("name", F.lit("a file without a name")), F.lit(" has no partner, or several"))
    whole = (F.col("n") == 2) & F.col("left").isNotNull() & F.col("right").isNotNull()
    return both.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(said).isNull())).select("name", "place", "left", "right")


def positional_logits(spark: SparkSession, segments: str, predictions: str, classes: list[str], name: Column) -> DataFrame:
    """(name, place, id, text, predicted, classes...): segments in JSON lines beside the predictions in the lines of files of the same names, which have a header."""
    both = zipped(numbered_lines(spark, segments), numbered_lines(spark, predictions, header=True), name)
    told = F.from_csv("right", F.lit("predicted int, " + ", ".join(f"{c} double" for c in classes)), {"sep": "\t"})
    line = F.from_json("left", "id string, text string")
    return both.select("name", "place", line.alias("l"), told.alias("r")).select("name", "place", "l.id", "l.text", "r.*")


def sampled_files(spark: SparkSession, path: str, share: float, seed: int = 42, name: Column | None = None) -> list[str]:
    """The paths of floor(share * n) of the n files that match, first in the order of a hash of their name (by default the last part of the path).

    Only the files' names are read here; a scan of the result reads no other file.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1) if name is None else name
    order = F.md5(F.concat_ws("|", name, F.lit(str(seed))))
    n = files.count()
    return [r["path"] for r in files.orderBy(order, "path").limit(int(n * share + 1e-9)).collect()]


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors beside their terms: (term, speech_id, sent_index, vector)."""
    return spark.read.schema("term string, speech_id string, sent_index int, vector array<float>").parquet(path)


def surveys(files: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Files with columns of their own, each with a mapping from its names to the common ones, as one table."""
    named = [df.select(*[F.col(old).alias(new) for old, new in names.items()]) for df, names in files]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
