import random

import numpy as np
import pyarrow as pa
import pytest
from brute_force import LOWER, brute_components, shingle_set, split_words
from pyspark.sql import functions as F

from lectern.llm import bytes_kit, components, jaccard_join, linking, substring_dedup


def test_words_and_shingles():
    texts = ["", None, "A b  c", "x y", " lead trail \n", "a\tb\nc d e f", "éa Éa", "y" * 30, "ab"]
    for block in (1 << 20, 3):
        bytes_kit.BLOCK = block
        data, ends = bytes_kit.buffers(pa.array(texts))
        hashes, first, stop, at = bytes_kit.words(data, ends)
        got = [[bytes(data[first[j] : stop[j]]).decode() for j in range(at[i], at[i + 1])] for i in range(len(texts))]
        assert [[w.translate(LOWER) for w in ws] for ws in got] == [split_words(t) for t in texts]
    bytes_kit.BLOCK = 1 << 20
    flat, at = bytes_kit.shingles(hashes, at, 5)
    assert np.diff(at).tolist() == [len(split_words(t)) - 4 if len(split_words(t)) >= 5 else int(bool(split_words(t))) for t in texts]


def variants(seed, n_base=12, copies=8):
    """Texts with exact copies, edits of several sizes, shared passages, tiny and empty texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(3))
    passage = " ".join(word() for _ in range(60))
    out = ["", " ", None, "one two", "one two", "One  TWO", "a b c d e", "a b c d e f"]
    for _ in range(n_base):
        words = [word() for _ in range(draw.choice([6, 20, 80, 300, 1500]))]
        for c in range(copies):
            edited = list(words)
            for _ in range(draw.randrange(0, max(2, len(words) // 18))):
                edited[draw.randrange(len(edited))] = word()
            out.append(" ".join(edited) + (" " + passage if c % 4 == 0 else ""))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    texts = variants(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_components({i: shingle_set(t) for i, t in enumerate(texts)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == {i: (len(shingle_set(t)), want[i]) for i, t in enumerate(texts)}
    assert len(set(want.values())) < len(texts) - 20


def test_small_chunks_and_pieces_change_nothing(spark, monkeypatch):
    texts = variants(3, 6)
    want = brute_components({i: shingle_set(t) for i, t in enumerate(texts)})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(linking, "CHUNK", 3)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    assert got == want


def test_long_groups_are_passed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(linking, "HELD", 5)
    key = np.repeat([1, 2, 3], [2, 40, 3])
    ids = np.concatenate([[5, 9], np.arange(40), [7, 8, 9]])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 7]), pa.array(ids[i : i + 7])], names=["key", "id"]) for i in range(0, len(key), 7)]
    pairs, members = set(), set()
    for b in linking.meet(iter(batches)):
        for x, y, big in zip(*[c.to_pylist() for c in b.columns], strict=True):
            (members if big else pairs).add((x, y))
    assert pairs == {(5, 9), (7, 8), (7, 9)} | {(0, i) for i in range(1, 40)}
    assert members == {(2, i) for i in range(40)} | {(3, 7), (3, 8), (3, 9)}


def test_groups_of_the_same_members_are_one():
    key, ids = np.repeat([1, 2, 3], [3, 3, 4]), np.array([4, 5, 6, 4, 5, 6, 4, 5, 6, 7])
    found = [r for b in linking.meet_by_members(iter([pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], names=["key", "id"])])) for r in b.to_pylist()]
    groups: dict[int, set[int]] = {}
    for r in found:
        if r["big"]:
            groups.setdefault(r["a"], set()).add(r["b"])
    assert sorted(map(sorted, groups.values())) == [[4, 5, 6], [4, 5, 6, 7]]


def _cut_groups(spark, monkeypatch, chunk):
    """The pairs that are compared across the components of one group, by the pieces that its rows go to."""
    monkeypatch.setattr(linking, "CHUNK", chunk)
    rows = [(1, i, 0 if i < 23 else i, 0, 23, 9) for i in range(32)]
    df = spark.createDataFrame(rows, "bucket long, id long, component long, largest long, inside long, outside long")
    spread = df.select("bucket", "id", "component", F.explode(linking._pieces()).alias("p")).select("bucket", "p.*", "id", "component", F.lit(40).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    out = spread.orderBy("bucket", "i", "j").coalesce(1).mapInArrow(linking._across(75, 100, False), "u long, v long, part boolean").collect()
    return sorted((r.u, r.v) for r in out)


def test_a_group_in_pieces_compares_each_pair_across_components_once(spark, monkeypatch):
    want = sorted((i, j) for j in range(23, 32) for i in range(j))
    assert _cut_groups(spark, monkeypatch, 100) == want
    assert _cut_groups(spark, monkeypatch, 4) == want


def test_sharper_sketches_lose_no_link():
    draw = np.random.default_rng(8)
    pool = draw.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    sets = [np.unique(pool[low : low + n]) for low, n in ((0, 600), (70, 600), (90, 500), (300, 600), (0, 1030), (60, 1010), (10, 900), (9000, 9000), (9900, 9000), (11_900, 9000))]
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    wide = jaccard_join.wide_sketches(flat, at)
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if min(len(sets[i]), len(sets[j])) * 4 >= 3 * max(len(sets[i]), len(sets[j]))]
    u, v = (pa.array([p[k] for p in pairs]) for k in (0, 1))
    size = pa.array([len(x) for x in sets])
    batch = pa.RecordBatch.from_arrays([u, v, size.take(u), wide.take(u), size.take(v), wide.take(v)], names=list("abcdef"))
    kept = {(r["u"], r["v"]) for b in linking._sharper(75, 100)(iter([batch])) for r in b.to_pylist()}
    alike = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in pairs}
    assert {p for p, x in alike.items() if x >= 0.75} <= kept
    assert not {p for p, x in alike.items() if x < 0.6} & kept


def test_sketch_distance_is_a_lower_bound():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(base[:2600]), np.unique(base[400:])
    flat, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    apart = len(set(a.tolist()) ^ set(b.tolist()))
    narrow = jaccard_join.sketches(flat, at, 16)
    assert 0 < np.bitwise_count((narrow[0] ^ narrow[1]).view(np.uint64)).sum() <= apart
    wide = [np.frombuffer(w, np.uint8) for w in jaccard_join.wide_sketches(flat, at).to_pylist()]
    assert 400 < np.bitwise_count(wide[0] ^ wide[1]).sum() <= apart


def test_jaccard_on_odd_rows(odd_docs, no_docs):
    out = jaccard_join.jaccard_components(odd_docs).collect()
    assert len(out) == odd_docs.count()
    got = {r.doc_id: r.component_id for r in out if r.doc_id is not None}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10}
    assert all(r.component_id is None for r in out if r.doc_id is None)
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    kept = jaccard_join.keep_one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 7, 7, 9, 10]


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, i) for i in range(201, 260)] + [(None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 260)}


def brute_paragraphs(docs):
    """(id, line, start, chars, words, keep id, keep line, removed) of paragraphs that repeat across documents."""
    found, sets, number = [], {}, {}
    for i, t in docs:
        at = 0
        for n, line in enumerate((t or "").split("\n")):
            w = split_words(line)
            if i is not None and len(w) >= substring_dedup.MIN_WORDS:
                k = number.setdefault(tuple(w), len(number))
                sets[k] = shingle_set(line)
                found.append((i, n, at, len(line), len(w), k))
            at += len(line) + 1
    lead = brute_components(sets)
    homes, keep = {}, {}
    for i, n, *_, k in found:
        homes.setdefault(lead[k], set()).add(i)
        keep[lead[k]] = min(keep.get(lead[k], (i, n)), (i, n))
    return sorted((i, n, a, c, w, *keep[lead[k]], (i, n) != keep[lead[k]]) for i, n, a, c, w, k in found if len(homes[lead[k]]) > 1)


def test_paragraphs_match_brute_force(spark):
    draw = random.Random(4)
    word = lambda: draw.choice(["é", ""]) + "".join(draw.choice("abcdefgh") for _ in range(3))
    passages = [[word() for _ in range(draw.randrange(42, 120))] for _ in range(8)]
    docs = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(draw.randrange(3, 80))) for _ in range(3)] + [""]
        for p in draw.sample(passages, draw.randrange(0, 3)):
            p = list(p)
            for _ in range(draw.randrange(0, 3)):
                p[draw.randrange(len(p))] = word()
            lines.insert(draw.randrange(len(lines) + 1), " ".join(p))
        docs.append((i, "\n".join(lines)))
    docs += [(60, None), (61, ""), (None, " ".join(passages[0])), (62, "\n" + " ".join(passages[0]) + "\n"), (62, "\n" + " ".join(passages[0]) + "\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.para_no, r.start, r.n_chars, r.n_words, r.keep_id, r.keep_para_no, r.removed) for r in substring_dedup.repeated_paragraphs(df).collect())
    assert got == brute_paragraphs(docs) and len(got) > 20
    gone = {}
    for r in got:
        gone.setdefault(r[0], set()).update([r[1]] if r[7] else [])
    cleaned = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).where("doc_id < 60").collect()}
    assert cleaned == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t in docs if i is not None and i < 60}


def test_paragraphs_of_odd_rows(odd_docs, no_docs):
    assert {(r.doc_id, r.removed) for r in substring_dedup.repeated_paragraphs(odd_docs).collect()} == {(5, False), (6, True)}
    assert substring_dedup.repeated_paragraphs(no_docs).count() == 0
    assert substring_dedup.remove_repeats(odd_docs).columns == odd_docs.columns
