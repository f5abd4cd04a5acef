import glob
import json

import pytest
from pyspark.sql import functions as F

from lectern.sources import readers, writers


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{x}\n" for x in lines))


@pytest.fixture
def pair(tmp_path):
    n = {"a": 3000, "b": 1, "c": 700}
    for name, k in n.items():
        write(tmp_path / "seg" / f"s-{name}.jsonl", [json.dumps({"id": f"{name}{i}", "text": "é" * (i % 40)}) for i in range(k)])
        write(tmp_path / "pred" / f"p-{name}.tsv", ["predicted\tno\tyes", *[f"{i % 2}\t{i}.5\t{-i}" for i in range(k)]])
    return tmp_path, n


def name():
    return F.regexp_extract("file", r"-(\w)\.", 1)


def test_lines_keep_their_order_over_many_splits(spark, pair, monkeypatch):
    path, n = pair
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        lines = readers.numbered_lines(spark, f"{path}/seg/*")
        assert lines.rdd.getNumPartitions() > 0 and spark.read.text(f"{path}/seg/*").rdd.getNumPartitions() > 10
        got = {(r.file[-7], r.place): json.loads(r.value)["id"] for r in lines.collect()}
        assert got == {(k, i): f"{k}{i}" for k in n for i in range(n[k])}
        both = readers.positional_logits(spark, f"{path}/seg/*", f"{path}/pred/*", ["no", "yes"], name())
        assert {r.id: (r.place, r.predicted, r.no, r.yes) for r in both.collect()} == {f"{k}{i}": (i, i % 2, i + 0.5, -float(i)) for k in n for i in range(n[k])}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("side", ["seg", "pred"])
def test_a_short_file_raises(spark, pair, side):
    path, _ = pair
    file = next((path / side).glob("*c.*"))
    file.write_text("\n".join(file.read_text().split("\n")[:-2]) + "\n")
    both = readers.positional_logits(spark, f"{path}/seg/*", f"{path}/pred/*", ["no", "yes"], name())
    with pytest.raises(Exception, match="line 699 of c has no partner"):
        both.agg(F.sum("yes")).collect()


def test_a_missing_file_raises(spark, pair):
    path, _ = pair
    next((path / "pred").glob("*b.*")).unlink()
    with pytest.raises(Exception, match="line 0 of b has no partner"):
        readers.positional_logits(spark, f"{path}/seg/*", f"{path}/pred/*", ["no", "yes"], name()).select("id").collect()


def test_only_chosen_files_are_read(spark, tmp_path):
    for i in range(20):
        write(tmp_path / "2019" / f"{i % 4}" / f"f{i}.json", [json.dumps({"speaker": f"s{i}"})])
    chosen = readers.sampled_files(spark, f"{tmp_path}/2019/*/*.json", 0.1)
    assert len(chosen) == 2 and chosen == readers.sampled_files(spark, f"{tmp_path}/2019/*/*.json", 0.1)
    assert set(readers.sampled_files(spark, f"{tmp_path}/2019/*/*.json", 0.5)) > set(chosen) and chosen != readers.sampled_files(spark, f"{tmp_path}/2019/*/*.json", 0.1, seed=1)
    df = readers.json_lines(spark, chosen, "speaker string")
    assert len(df.inputFiles()) == 2 and df.count() == 2
    assert readers.sampled_files(spark, f"{tmp_path}/2019/*/*.json", 0.04) == []


def parts(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_one_sorted_map(spark, tmp_path):
    rows = [(f'k"{i}é', i, None if i % 3 else "x\ty") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, n int, a string").repartition(5)
    writers.json_map(df, f"{tmp_path}/map", "id")
    text = parts(f"{tmp_path}/map")
    assert json.loads(text) == {k: {"n": n} | ({"a": a} if a else {}) for k, n, a in rows} and list(json.loads(text)) == sorted(r[0] for r in rows)


def test_row_index(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "i int, v string").repartition(4)
    writers.separated(df, f"{tmp_path}/t", index=["i"])
    lines = [x.split("\t") for f in sorted(glob.glob(f"{tmp_path}/t/part-*")) for x in open(f).read().splitlines()[1:]]
    assert lines == [[str(i), str(i), f"v{i}"] for i in range(50)]


def test_tables_have_errors_and_stars(spark, tmp_path):
    rows = [("one", "x_1", 1.23456, 0.5, 0.0004), ("one", "y", -0.2, 0.123, 0.2), ("two", "y", 0.3, 0.1, 0.03)]
    df = spark.createDataFrame(rows, "spec string, term string, estimate double, se double, p double")
    writers.regression_table(df, f"{tmp_path}/text", "spec")
    assert [x.split("\t") for x in parts(f"{tmp_path}/text").splitlines()] == [["term", "one", "two"], ["x_1", "1.235*** (0.50)", '""'], ["y", "-0.200 (0.12)", "0.300* (0.10)"]]
    writers.regression_table(df, f"{tmp_path}/tex", "spec", latex=True)
    assert parts(f"{tmp_path}/tex").splitlines() == ["term & one & two \\\\ \\hline", "x\\_1 & 1.235*** (0.50) &  \\\\", "y & -0.200 (0.12) & 0.300* (0.10) \\\\"]


def test_splits_have_each_row_once_a_fold(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "id int, v string").repartition(3)
    writers.splits(df, f"{tmp_path}/s", "id", 3, 0.25)
    rows = spark.read.json(f"{tmp_path}/s").collect()
    assert sorted((r.fold, r.id) for r in rows) == [(f, i) for f in range(3) for i in range(100)]
    tests = [{r.id for r in rows if r.fold == f and r.split == "test"} for f in range(3)]
    assert all(len(x) == 25 for x in tests) and tests[0] != tests[1]


def test_a_name_is_written_in_pieces(spark, sf_dir, tmp_path, monkeypatch):
    from lectern.plans import files, registry

    monkeypatch.setattr(files, "folder", lambda t, name: f"{tmp_path}/{spark.conf.get('spark.sql.shuffle.partitions')}-{name}")
    before, told = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for n in ("4", "28"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            told[n] = sorted(registry.QUERIES["positional_zip"](spark, sf_dir).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert told["4"] == told["28"] and len(told["28"]) == 7
    for side in ("segments", "predictions"):
        assert len(glob.glob(f"{tmp_path}/28-{side}/part=3/**/part-*", recursive=True)) == 4
