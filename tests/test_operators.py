"""Hand-made cases: ties, empty inputs, single elements, other alphabets."""

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import dates, scores, text
from lectern.functions.tails import t_tail
from lectern.operators import counts, joins, labels, models, permutation, segment, stats
from lectern.sources import readers, writers
from lectern.vocab import EARLY, MID, MODERN


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_rejoin(spark):
    df = spark.createDataFrame([(1, 0, "I met him."), (1, 1, "in 1890."), (1, 2, "Good."), (2, 0, "Well"), (2, 1, "then."), (3, 0, ""), (4, 0, "a"), (4, 1, "$5"), (5, 0, "x."), (5, 1, "élan")], "k int, pos int, s string")
    said = {(r.k, r.grp): r.text for r in segment.rejoin(df, "k", "pos", "s").collect()}
    assert said == {(1, 0): "I met him. in 1890.", (1, 1): "Good.", (2, 0): "Well", (2, 1): "then.", (4, 0): "a", (4, 1): "$5", (5, 0): "x. élan"}
    loose = {(r.k, r.grp): r.text for r in segment.rejoin(df, "k", "pos", "s", need_period=False).collect()}
    assert loose[(2, 0)] == "Well then." and loose[(4, 0)] == "a $5"


def test_pack(spark):
    lens = F.array(*[F.lit(x).cast("long") for x in (200, 200, 10, 400, 5)])
    assert one(spark, segment.pack(lens)) == [0, 1, 1, 2, 3]
    df = spark.createDataFrame([(1, "a b\nc\n\nd e f"), (2, ""), (3, None)], "k int, t string")
    rows = segment.blocks(df, "k", F.split("t", "\n"), 3).orderBy("k", "block").collect()
    assert [(r.k, r.block, r.n_tokens, r.text) for r in rows] == [(1, 0, 3, "a b c"), (1, 1, 3, "d e f")]
    draw = random.Random(1)
    many = [(k, "\n".join("x " * draw.randrange(0, 9) + "\ty" for _ in range(draw.randrange(1, 200)))) for k in range(30)]
    df = spark.createDataFrame(many, "k int, t string")
    want = []
    for k, t in many:
        parts: list[list[str]] = []
        for sent in t.split("\n"):
            if not parts or sum(len(x.split()) for x in parts[-1]) + len(sent.split()) > 20:
                parts.append([])
            parts[-1].append(sent)
        want += [(k, i, sum(len(x.split()) for x in p), " ".join(p)) for i, p in enumerate(parts)]
    assert sorted(tuple(r) for r in segment.blocks(df, "k", F.split("t", "\n"), 20).collect()) == sorted(want)
    long = spark.createDataFrame([(0, "a b c\n" * 40_000)], "k int, t string")
    assert segment.blocks(long, "k", F.split("t", "\n"), 30).agg(F.count("*"), F.sum("n_tokens")).first()[:] == (4_000, 120_000)


def test_numbering_goes_through_buckets(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    rows = labels.ranked(df, "id", 9, ["g"]).collect()
    for g in range(3):
        mine = sorted((r.rn, r.id) for r in rows if r.g == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [i for _, i in mine] == sorted((i for _, i in mine), key=lambda i: hashlib.md5(f"{i}|9".encode()).hexdigest())


@pytest.mark.parametrize(("given", "kept"), [({1: 0.9, 4: 0.95, 10: 0.6, 20: 0.7}, {4, 10, 20}), ({1: 0.8, 3: 0.8}, {3}), ({7: 0.5}, {7}), ({}, set())])
def test_suppress(spark, given, kept):
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("num")) for n, p in given.items()]) if given else F.array().cast("array<struct<p:double,num:int>>")
    assert {r.num for r in one(spark, segment.suppress(rows))} == kept


def test_context(spark):
    sents = F.array(*[F.lit(str(i)) for i in range(10)])
    got = one(spark, segment.contexts(sents, F.array(F.lit(1), F.lit(9))))
    assert [(r.center, r.text) for r in got] == [(1, "0 1 2 3 4"), (9, "6 7 8 9")]


def test_chunks(spark):
    assert one(spark, segment.chunks(arr(*"abcdefg"), F.lit(3))) == [["a", "b"], ["c", "d"], ["e", "f", "g"]]


def test_keywords(spark):
    match = lambda words, era: one(spark, text.keyword_match(arr(*words), era))
    assert not match(["germany"], EARLY) and match(["germans"], EARLY) and match(["the", "chinese"], EARLY)
    assert match(["foreign", "workers"], MID) and not match(["workers", "foreign"], MID)
    assert match(["ins"], MODERN) and not match(["inside"], MODERN) and match(["xxnonimmigrantxx"], EARLY)
    assert not match(["caribou"], MODERN) and match(["caribbean"], MODERN) and not match([], MODERN)


def test_text(spark):
    assert one(spark, text.simplify_text(F.lit("Hello, World-wide!  A"))) == "hello worldwide a"
    assert one(spark, text.normalize_text(F.lit("the farmer's o'clock, so-called a-b-c"))) == "the farmers oclock, socalled abc"
    assert one(spark, text.repair_prefix(F.lit("Tile SPEAKER"))) == "The SPEAKER" and one(spark, text.repair_prefix(F.lit("TieCHAIR"))) == "TieCHAIR".replace("Tie", "The ")
    assert one(spark, text.canonical_title(F.lit("The  PRESIDENT"))) == "The PRESIDENT pro tempore"
    assert one(spark, text.zero_pad(F.lit(7), 3)) == "007" and one(spark, text.zero_pad(F.lit(12345), 3)) == "12345"
    assert one(spark, text.retokenize_possessives(arr("'s", "dog", "'s", "tail"), arr("POS", "NN", "POS", "NN"))) == ["'s", "dog's", "tail"]
    assert one(spark, text.retokenize_possessives(arr("dogs", "'", "tail"), arr("NN", "POS", "NN"))) == ["dogs", "'", "tail"]
    assert one(spark, text.append_fused(arr("farm (n)", "worker (n)"))) == ["farm (n)", "worker (n)", "farmworker (n)"]
    assert one(spark, text.ngrams(arr("a"), 2)) == [] and one(spark, text.ngrams(arr("a", "b", "c"), 2)) == ["a_b", "b_c"]
    assert one(spark, text.fuse_phrases(F.lit("a Mexican-American and Asian Americans"), ["Asian", "Mexican"], ["American"])) == "a MexicanAmerican and AsianAmericans"
    assert one(spark, text.mask_word(F.lit("im ##migrant here"), "immigrant")) == "[MASK] here"
    assert one(spark, text.strip_prefix(F.lit("Mr. X.  Yes"), F.lit("Mr. X"))) == "Yes" and one(spark, text.strip_prefix(F.lit("No"), F.lit("Mr. X"))) is None


@pytest.mark.parametrize(("day", "session"), [("2019-01-02", 115), ("2019-01-03", 116), ("1789-03-04", 1)])
def test_sessions(spark, day, session):
    assert one(spark, dates.date_to_session(F.lit(day).cast("date"))) == session


def test_dates(spark):
    assert one(spark, dates.year_to_session(F.lit(1790))) == 1 and one(spark, dates.session_to_year(F.lit(43))) == 1874
    assert one(spark, dates.white_house_party(F.lit("1865-01-01").cast("date"))) is None and one(spark, dates.white_house_party(F.lit("1933-03-04").cast("date"))) == "D"
    assert one(spark, dates.trailing_year(F.lit("May 5, 1934"))) == 1934 and one(spark, dates.trailing_year(F.lit("soon"))) is None
    assert one(spark, dates.month_number(F.lit("december"))) == 12 and one(spark, dates.month_number(F.lit("smarch"))) is None
    assert one(spark, dates.months_to_election(F.lit("2020-12-01").cast("date"))) == 23


def test_scores(spark):
    p = [F.lit(x) for x in (0.4, 0.2, 0.4)]
    assert one(spark, scores.argmax_label(dict(zip(scores.TONES, p, strict=True)))) == "anti"
    assert math.isclose(one(spark, scores.tone(F.lit(0.5), F.lit(0.5), F.lit(1.0))), 1 / 6)
    assert one(spark, scores.tone(*[F.lit(None).cast("double")] * 3)) == 0 and one(spark, scores.binary_tone(F.lit(0), F.lit(0))) is None
    assert math.isclose(one(spark, scores.interpolate(F.lit(0.2), F.lit(0.8), F.lit(79))), 0.5)
    assert math.isclose(sum(one(spark, x) for x in scores.softmax(F.lit(800.0), F.lit(1.0))), 1.0)
    fixed = scores.confusion_corrected(p, [F.lit(1 / 3)] * 3, [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]])
    assert math.isclose(sum(one(spark, x) for x in fixed), 1.0)


def test_islands(spark):
    df = spark.createDataFrame([(k, x) for k, xs in {1: (1, 2, 5, 6), 2: (1, 2, 4, 6, 7), 3: (3,), 4: (1, 3, 4)}.items() for x in xs], "k int, p int")
    got = {}
    for r in segment.islands(df, ["k"], "p").collect():
        got.setdefault((r.k, r.block), set()).add(r.p)
    assert got == {(1, 0): {1, 2, 5, 6}, (2, 0): {1, 2}, (2, 1): {6, 7}, (4, 0): {3, 4}}


def test_leave_one_out(spark):
    df = spark.createDataFrame([("a", 1, 5, 4), ("b", 1, 15, 6), ("c", 2, 3, 1)], "e string, p int, n int, pos int")
    got = {(r.e, r.p): r.rest for r in counts.leave_one_out(df, "e", "p", "n", "pos").collect()}
    assert got == {("a", 1): 0.4, ("b", 1): 0.8, ("c", 2): None}


def test_agreement(spark):
    df = spark.createDataFrame([("x", "1", "a"), ("x", "2", "a"), ("y", "1", "a"), ("y", "2", "b"), ("z", "1", "b")], "i string, w string, r string")
    assert abs(labels.krippendorff_alpha(df, "i", "w", "r").first().alpha) < 1e-12


def test_president_lines(spark):
    rows = [(1, 0, 0), (1, 1, 2), (1, 2, 0), (1, 3, 1), (1, 4, 0), (2, 0, 0), (2, 1, 0)]
    kept = segment.president_lines(spark.createDataFrame(rows, "k int, pos int, kind int"), "k", "pos", "kind")
    assert sorted((r.k, r.pos) for r in kept.collect()) == [(1, 0), (1, 3), (1, 4), (2, 0), (2, 1)]


def test_joins(spark):
    facts = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "b", 5), (4, None, 5)], "id int, who string, t int")
    terms = spark.createDataFrame([("a", 1, 6, 0, "x"), ("a", 4, 8, 1, "y")], "who string, lo int, hi int, pos int, party string")
    got = joins.interval_last(facts, terms, "who", "t", "lo", "hi", "pos", ["party"], ["id"])
    assert {r.id: r.party for r in got.collect()} == {1: "y", 2: None, 3: None, 4: None}
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="repeats a key"):
        joins.one_to_one(twice, spark.createDataFrame([(1, 2)], "k int, z int"), ["k"]).collect()
    words = spark.createDataFrame([(w, 1) for w in ("cat", "cart", "bat", "cats", "dog", "ca")], "word string, n int")
    near = {(r.word, r.other) for r in joins.one_edit_neighbours(words).collect()}
    assert {o for w, o in near if w == "cat"} == {"cart", "bat", "cats", "ca"} and not any(w == "dog" for w, _ in near)


def test_stats(spark):
    tail = lambda t, df: spark.range(1).select(t_tail(F.lit(t), F.lit(df))).first()[0]
    assert math.isclose(tail(2.0, 10), 0.07338803477074, rel_tol=1e-9) and math.isclose(tail(0.0, 5), 1.0)
    df = spark.createDataFrame([(i, i % 2, float(i % 2) + i / 100) for i in range(60)], "id int, g int, v double")
    p = permutation.permutation_test(df, "v", "g", 200).first()
    assert p.p_value < 0.05 and p.replicates == 200
    line = spark.createDataFrame([(1, float(x), 2.0 * x + 1) for x in range(5)], "k int, x double, y double")
    r = stats.slope_by(line, ["k"], "y", "x").first()
    assert math.isclose(r.slope, 2) and math.isclose(r.intercept, 1) and r.n == 5


def test_models(spark):
    df = spark.createDataFrame([(["good", "fine"], 1.0), (["bad", "poor"], 0.0)] * 20, "w array<string>, label double")
    features, model = models.ngram_classifier(df, "w", "label", reg=0.001)
    assert model.transform(features.transform(df)).where("label = prediction").count() == 40
    assert {r.term for r in models.weights_table(spark, features, model).collect()} <= {"good", "fine", "bad", "poor", "good fine", "bad poor"}
    only = df.where("label = 1")
    features, model = models.ngram_classifier(only, "w", "label")
    assert model.transform(features.transform(only)).where("prediction = 1").count() == 20
    names, fit = models.least_squares(spark.createDataFrame([(float(x), 3.0 * x + 2) for x in range(6)], "x double, y double"), "y ~ x")
    assert names == ["x"] and math.isclose(fit.coefficients[0], 3, rel_tol=1e-6)
    out = models.with_model(df.select("label"), "label double, p double", lambda: lambda b: b.assign(p=b.label / 2))
    assert {(r.label, r.p) for r in out.collect()} == {(1.0, 0.5), (0.0, 0.0)}


def test_sources(spark, tmp_path):
    (tmp_path / "speeches.txt").write_bytes("speech_id|speech\n430001|Hé said “|so|\n430002|\n".encode("windows-1252"))
    got = readers.pipe_speeches(spark, str(tmp_path / "speeches.txt")).orderBy("speech_id").collect()
    assert [(r.speech_id, r.text) for r in got] == [("430001", "Hé said “ so "), ("430002", "")]
    dates_ = spark.createDataFrame([("430001", "18940614"), ("430002", "18940615")], "speech_id string, date string")
    assert [r.speech_id for r in readers.without_corrupt_day(readers.pipe_speeches(spark, str(tmp_path / "speeches.txt")), dates_).collect()] == ["430002"]
    (tmp_path / "page.json").write_text('{"id": "p", "header": {"chamber": "H", "year": "2001", "month": "1", "day": "2"}, "content": [{"kind": "speech", "speaker": "None", "speaker_bioguide": "B1", "text": "x"}, {"kind": "other", "text": "y"}, {"kind": "speech", "speaker": "Z", "text": "z"}]}')
    rows = readers.pages(spark, str(tmp_path / "page.json")).orderBy("id").collect()
    assert [(r.id, r.date, r.speaker, r.text) for r in rows] == [("p_0000", "20010102", None, "x"), ("p_0002", "20010102", "Z", "z")]
    (tmp_path / "map.json").write_text('{"s1": {"date": "20010101", "party": "D"}, "s2": {"date": "20010102"}}')
    assert {r.key: r.value.party for r in readers.json_map(spark, str(tmp_path / "map.json")).collect()} == {"s1": "D", "s2": None}
    (tmp_path / "ids.txt").write_text("a\n b \n\na\n")
    assert sorted(r.id for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    df = spark.createDataFrame([(43, "x"), (44, "y")], "session int, text string")
    writers.by_session(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("session = 44").select("text").first().text == "y"
    writers.separated(df, str(tmp_path / "tsv"))
    assert readers.separated(spark, str(tmp_path / "tsv"), "session int, text string").count() == 2
    writers.keyed_json(df, str(tmp_path / "keyed"), "session")
    assert spark.read.json(str(tmp_path / "keyed")).count() == 2


def test_stream(spark, tmp_path, sf_dir):
    from lectern.streaming.daily import daily_counts, read_events

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = daily_counts(read_events(spark, str(tmp_path / "in"), events.schema))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("daily").start()
    run.processAllAvailable()
    run.stop()
    want = {(r.day, r.event_type): r.n for r in events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.day, r.event_type): r.n for r in spark.sql("select * from daily").collect()} == want


def test_without_the_training_data_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[0]) > 100


def test_best_match_keeps_equal_rows(spark):
    left = spark.createDataFrame([("x", "smith"), ("x", "smith"), ("x", None), ("y", "jones"), ("z", "none")], "block string, a string")
    right = spark.createDataFrame([("x", "smyth"), ("x", "smitt"), ("y", "jones"), ("y", "jonas")], "block string, b string")
    got = sorted((r.block, r.a or "", r.b, r.score) for r in joins.best_match(left, right, ["block"], "a", "b").collect())
    assert got == [("x", "smith", "smitt", 80.0)] * 2 + [("y", "jones", "jones", 100.0)]


def test_many_ranges_meet_by_cells(spark, monkeypatch):
    import datetime as dt

    points = [(None,), *((x / 3,) for x in range(-30, 400))]
    spans = [(0.0, 5.5), (5.5, 5.5), (-9.0, 100.0), (7.25, 7.5), (99.0, 12.0), (None, 3.0), (50.0, 133.0), (50.0, 133.0)]
    want = sorted((x, a, b) for (x,) in points for a, b in spans if None not in (x, a, b) and a <= x < b)
    facts, ranges = spark.createDataFrame(points, "at double"), spark.createDataFrame(spans, "low double, high double")
    day = lambda n: None if n is None else dt.date(2020, 1, 1) + dt.timedelta(int(n))
    days, terms = spark.createDataFrame([(day(x),) for (x,) in points], "at date"), spark.createDataFrame([(day(a), day(b)) for a, b in spans], "low date, high date")
    few = [sorted(map(tuple, joins.in_range(f, r, "at", "low", "high").collect())) for f, r in ((facts, ranges), (days, terms))]
    assert few[0] == want
    monkeypatch.setattr(joins, "SMALL", 2)
    many = [joins.in_range(f, r, "at", "low", "high") for f, r in ((facts, ranges), (days, terms))]
    assert [sorted(map(tuple, m.collect())) for m in many] == few and all(m.columns == ["at", "low", "high"] for m in many)
    assert "Cartesian" not in many[0]._jdf.queryExecution().toString() and "NestedLoop" not in many[0]._jdf.queryExecution().toString()


def test_arrays_are_glued_in_lock_step(spark):
    sents = [(1, 0, ["Mr", "."], ["mr", "."]), (1, 1, ["smith", "said", "."], ["smith", "say", "."]), (1, 2, [], []), (1, 3, ["But", "."], ["but", "."]), (1, 4, ["1882"], ["1882"]), (1, 5, ["now"], ["now"]), (2, 0, ["so"], ["so"])]
    df = spark.createDataFrame(sents, "id long, pos int, tokens array<string>, lemmas array<string>").repartition(3)
    got = {(r.id, r.grp): (r.tokens, r.lemmas) for r in segment.rejoin_arrays(df, "id", "pos", "tokens", "lemmas").collect()}
    assert got == {
        (1, 0): (["Mr", ".", "smith", "said", "."], ["mr", ".", "smith", "say", "."]), (1, 1): (["But", ".", "1882"], ["but", ".", "1882"]),
        (1, 2): (["now"], ["now"]), (2, 0): (["so"], ["so"]),
    }


def test_f1_scores_without_true_positives_and_over_three_labels(spark):
    schema = "y int, p int, w double"
    none = labels.f1_scores(spark.createDataFrame([(1, 0, 1.0), (0, 0, 3.0)], schema), "y", "p", "w").first()
    assert none["binary"] == 0 and none["micro"] == pytest.approx(0.75) and none["macro"] == pytest.approx(6 / 7 / 2)
    some = labels.f1_scores(spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (2, 2, 2.0)], schema), "y", "p", "w").first()
    assert some["micro"] == pytest.approx(0.8) and some["macro"] == pytest.approx((1 + 2 / 3 + 0.8) / 3) and some["weighted"] == pytest.approx((1 + 2 * 2 / 3 + 2 * 0.8) / 5)


def test_robust_error_by_matrices(spark):
    rng = np.random.default_rng(4)
    g, x, w = rng.integers(0, 4, 80), rng.normal(size=80), rng.uniform(0.5, 2, 80)
    y = 2 * x + g + rng.normal(size=80) * (1 + abs(x))
    design = np.column_stack([x, *[g == i for i in range(4)]]).astype(float)
    bread = np.linalg.inv(design.T @ (design * w[:, None]))
    beta = bread @ (design.T @ (w * y))
    meat = design * (w * (y - design @ beta))[:, None]
    cov = bread @ (meat.T @ meat) @ bread * 80 / (80 - 5)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(g, y, x, w, strict=True)], "g int, y double, x double, w double")
    got = stats.within_slope(df, "g", "y", "x", "w").first()
    assert got.slope == pytest.approx(beta[0]) and got.robust_se == pytest.approx(cov[0, 0] ** 0.5)


def test_terms_of_the_president_elected_twice(spark):
    rows = [("Grover Cleveland", 1891), ("Grover Cleveland", 1892), ("Grover Cleveland", None), ("James A. Garfield", 1881), (None, 1900)]
    got = spark.createDataFrame(rows, "who string, year int").select(dates.term_label(F.col("who"), F.col("year")).alias("x"))
    assert [r.x for r in got.collect()] == ["Grover Cleveland (85-89)", "Grover Cleveland (93-97)", "Grover Cleveland", "James A. Garfield", None]


def test_joined_ngrams(spark):
    from lectern.functions import text as T

    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, []), (4, None)], "i int, w array<string>")
    got = {r.i: (list(r.two), list(r.three)) for r in df.select("i", T.ngrams(F.col("w"), 2).alias("two"), T.ngrams(F.col("w"), 3).alias("three")).collect()}
    assert got == {1: (["a_b", "b_c"], ["a_b_c"]), 2: ([], []), 3: ([], []), 4: ([], [])}
    plan = df.select(T.ngrams(F.col("w"), 2).alias("two"))._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "array_join(" not in plan
