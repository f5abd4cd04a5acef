import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lectern.llm import exact_dedup, mixing, sharding


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_on_odd_rows(odd_docs):
    out = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(out) == odd_docs.count()
    groups = defaultdict(list)
    for r in out:
        assert r.text_sha256 == hashlib.sha256(normal(r.text).encode()).hexdigest()
        groups[r.text_sha256].append(r)
    for rows in groups.values():
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert {r.keep_id for r in rows} == {min(ids) if ids else None}
        assert {r.group_size for r in rows} == {len(rows)}
        kept = [r for r in rows if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


@pytest.mark.parametrize("support", [0.001, 0.2, 0.9])
def test_heavy_hitters_change_nothing(spark, support):
    rows = [(i, "hot" if i % 3 else f"text {i % 40}") for i in range(300)] + [(1, "hot")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = exact_dedup.exact_dedup(df, support=support, narrow=True).collect()
    sizes, least = Counter(t for _, t in rows), {}
    for i, t in rows:
        least[t] = min(i, least.get(t, i))
    by = {hashlib.sha256(t.encode()).hexdigest(): t for t in sizes}
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == sorted((i, least[t], sizes[t]) for i, t in rows)
    assert Counter(by[r.text_sha256] for r in out if r.kept) == Counter(sizes.keys())


def test_exact_dedup_keeps_columns_and_empty_tables(odd_docs, no_docs):
    assert exact_dedup.drop_duplicates(odd_docs).columns == odd_docs.columns
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_shards_are_gapless_and_stable(odd_docs, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (odd_docs, docs):
        out = sharding.assign_shards(df, 16).collect()
        assert len(out) == df.count()
        slots = defaultdict(list)
        for r in out:
            raw = (r.text or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and 0 <= r.shard < 16
            assert r.grown_shard in (r.shard, 16)
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_depends_on_key_only(spark):
    ids = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    own = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign_shards(ids, 16).collect()}
    other = sharding.assign_shards(ids.where("doc_id % 3 = 0").selectExpr("doc_id", "'x' as text"), 16).collect()
    assert all(own[r.doc_id] == (r.shard, r.grown_shard) for r in other)
    counts = Counter(s for s, _ in own.values())
    assert all(abs(n - 1250) < 200 for n in counts.values())
    assert abs(sum(g == 16 for _, g in own.values()) - 20_000 / 17) < 200


def test_weights_confine_movement(spark):
    def tree(w):
        leaf = lambda i, w: sharding.Node(f"s{i}", w, (), i)
        return sharding.Node("root", children=(sharding.Node("a", children=(leaf(0, 1.0), leaf(1, 1.0))), sharding.Node("b", children=(leaf(2, w), leaf(3, 1.0)))))

    ids = spark.range(5000)
    rows = ids.select(sharding.shard_of(ids.id, tree(1.0)).alias("x"), sharding.shard_of(ids.id, tree(0.0)).alias("y")).collect()
    moved = Counter((r.x, r.y) for r in rows if r.x != r.y)
    assert moved and all(x in (2, 3) for x, _ in moved) and (0, 1) not in moved and (1, 0) not in moved
    assert not any(r.y == 2 for r in rows)


def fill(sizes, weights=(5, 2, 1), total=1.5, cap=2.0):
    """Shares by weight; what is over a cap goes to the others, again and again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    left, open_, out = total * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[n] for n in open_)
        over = [n for n in open_ if level * w[n] >= cap * sizes[n]]
        if not over:
            out |= {n: level * w[n] for n in open_}
            break
        for n in over:
            out[n] = cap * sizes[n]
            left -= out[n]
            open_.discard(n)
    return out


def test_mixing_targets_and_sizes(odd_docs, spark, sf_dir):
    for df in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        out = mixing.mix(df).collect()
        assert len(out) == df.count()
        sizes, taken, largest = Counter(), Counter(), Counter()
        for r in out:
            assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r["size"])
        want = fill(sizes)
        for r in out:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert all(abs(taken[s] - want[s]) <= 2 * largest[s] + 1 for s in sizes)
        if df is not odd_docs:
            assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in sizes)


def test_mixing_reruns_agree_and_emits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(map(tuple, mixing.mix(docs, narrow=True).collect()), key=repr)
    two = sorted(map(tuple, mixing.mix(docs.repartition(7), narrow=True).collect()), key=repr)
    assert one == two
    mixed = mixing.mix(docs)
    emitted = mixing.emit(mixed, docs.columns)
    assert emitted.columns == docs.columns
    assert Counter(r.doc_id for r in emitted.collect()) == Counter({r.doc_id: r.copies for r in mixed.collect() if r.copies})


def test_large_documents_are_made_up_for(spark):
    rows = [(i, "hot", "w " * (40 + i % 60)) for i in range(600)] + [(1000 + i, "hot", "w " * 4000) for i in range(3)] + [(2000 + i, "b", "w " * (10 + i)) for i in range(40)]
    out = mixing.mix(spark.createDataFrame([*rows, *rows[:5], rows[601]], "doc_id long, source string, text string")).collect()
    for s in ("hot", "b"):
        some = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in some) - some[0].target) <= 100
        each = some[0].target / some[0].source_size
        assert {r.copies for r in some if r["size"] < 200} <= {int(each), int(each) + 1} or s == "hot"
        assert max(r.copies for r in some) <= 2


def test_mixing_of_nothing(no_docs, spark):
    assert mixing.mix(no_docs).count() == 0
    silent = spark.createDataFrame([(1, None, None), (2, None, "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(silent).collect()] == [(0.0, 0), (0.0, 0)]
