import math
import os
import random

import duckdb
import pytest

from lectern.functions import scores
from lectern.plans import QUERIES, SQL

LARGE = "/root/testdata/sf0.1"


def test_share_sums_round_once_in_any_order(spark):
    draw = random.Random(3)
    groups = {g: [draw.random() * draw.choice([1, 1e-3, 1e-9]) for _ in range(draw.randrange(1, 60))] for g in range(300)}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    for _ in range(2):
        draw.shuffle(rows)
        df = spark.createDataFrame(rows, "g int, x double").repartition(5)
        got = {r.g: r.s for r in df.groupBy("g").agg(scores.share_sum(df.x).alias("s")).collect()}
        assert got == {g: math.fsum(xs) for g, xs in groups.items()}
    odd = spark.createDataFrame([(1, None), (2, float("nan")), (2, 0.5), (3, 0.0)], "g int, x double")
    got = {r.g: r.s for r in odd.groupBy("g").agg(scores.share_sum(odd.x).alias("s")).collect()}
    assert got[1] is None and math.isnan(got[2]) and got[3] == 0.0


@pytest.mark.skipif(not os.path.exists(LARGE), reason="needs the larger tables")
def test_near_ties_of_tones_fall_as_in_sql(spark, tmp_path):
    """The speeches two of whose sums lie within 1e-9."""
    con = duckdb.connect()
    con.execute("set threads=1")
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{LARGE}/{t}.parquet'")
    tones = SQL["tone_aggregate"].replace("round(", "(").replace(", 6)", ")")
    near = f"select l_orderkey from ({tones}) where abs(\"anti\" - neutral) < 1e-9 or abs(\"anti\" - pro) < 1e-9 or abs(neutral - pro) < 1e-9"
    con.execute(f"copy (select * from lineitem where l_orderkey in ({near})) to '{tmp_path}/lineitem.parquet' (format parquet)")
    for t in ("orders", "customer"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    want = con.execute(SQL["net_tone_band"].replace(" lineitem", f" '{tmp_path}/lineitem.parquet'")).fetchall()
    got = QUERIES["net_tone_band"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10
