import random

from brute_force import split_words

from lectern.llm import substring_dedup


def brute_passages(docs, size):
    """{(id, word, removed)} of the runs of size words that documents share; first occurrences are kept."""
    places = {}
    for i, t in docs:
        w = split_words(t)
        for p in range(len(w) - size + 1):
            places.setdefault(tuple(w[p : p + size]), set()).add((i, p))
    out = set()
    for found in places.values():
        if len({i for i, _ in found}) > 1:
            out |= {(i, p + k, (i, p) != min(found)) for i, p in found for k in range(size)}
    return out


def test_passages_match_brute_force(spark):
    draw = random.Random(11)
    word = lambda: draw.choice(["é", "", "X"]) + "".join(draw.choice("abcdefgh") for _ in range(3))
    wrapped = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 90, 200)]
    docs = []
    for i in range(40):
        text = ""
        for p in draw.sample(passages, draw.randrange(0, 3)):
            cut = draw.randrange(0, max(1, len(p) - 50))
            some = [word() for _ in range(draw.randrange(30, 90))] + p[cut:] + [word() for _ in range(draw.randrange(30, 90))]
            text += wrapped(some, draw.choice([7, 12, 1000])) + draw.choice(["\n", " \n\n"])
        docs.append((i, text))
    docs += [(40, None), (41, ""), (42, docs[0][1] + docs[1][1]), (43, wrapped(passages[4], 9)), (43, wrapped(passages[4], 9)), (44, wrapped([word()] * 120, 10))]
    df = spark.createDataFrame([*docs, (None, docs[2][1])], "doc_id long, text string").repartition(3)
    rows = substring_dedup.repeated_passages(df).collect()
    text, got = dict(docs), set()
    for r in rows:
        span = text[r.doc_id][r.start : r.start + r.n_chars]
        before = len(split_words(text[r.doc_id][: r.start]))
        assert len(split_words(span)) == r.n_words >= 50 and text[r.doc_id][: r.start].count("\n") == r.para_no
        got |= {(r.doc_id, before + k, r.removed) for k in range(r.n_words)}
    want = brute_passages(docs, 50)
    assert got == want and len(want) > 1000
    assert {r.cluster for r in rows if r.removed} == {r.cluster for r in rows if not r.removed}
    assert len({r.cluster for r in rows}) == sum(not r.removed for r in rows)


def test_passages_in_short_and_in_long_lines_are_found(spark):
    passage = [f"w{i}" for i in range(60)]
    verse = "\n".join(" ".join(passage[i : i + 6]) for i in range(0, 60, 6))
    inside = " ".join([f"a{i}" for i in range(100)] + passage + [f"b{i}" for i in range(100)])
    df = spark.createDataFrame([(1, verse), (2, inside), (3, "other " * 70)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.keep_id, r.removed) for r in substring_dedup.repeated_pieces(df).collect())
    assert got == [(1, 60, 1, False), (2, 60, 1, True)]


def test_passages_of_odd_rows(odd_docs, no_docs):
    assert {(r.doc_id, r.keep_id, r.n_words, r.removed) for r in substring_dedup.repeated_passages(odd_docs).collect()} == {(5, 5, 30_000, False), (6, 5, 30_000, True)}
    assert substring_dedup.repeated_passages(no_docs).count() == 0


def test_removal_keeps_to_its_own_rows_and_names(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage, 7), (2, passage + "\nown line", 8), (2, "a sentence of its own\nand a second", 9), (None, passage, 10), (3, None, 11)]
    df = spark.createDataFrame(rows, "`doc.id` long, `the.text` string, gone_ int")
    got = sorted(((r[0], r[1], r[2]) for r in substring_dedup.remove_repeats(df, "doc.id", "the.text").collect()), key=lambda r: r[2])
    assert got == [(1, passage, 7), (2, "own line", 8), (2, "a sentence of its own\nand a second", 9), (None, passage, 10), (3, None, 11)]


def test_periodic_texts_are_a_row_not_one_a_word(spark):
    texts = {1: "buy now " * 4000, 2: "buy now " * 4000, 3: "other words\n" * 60 + "buy now " * 100, 4: " ".join(f"u{i}" for i in range(80))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    rows = substring_dedup.repeated_passages(df).collect()
    got = sorted((r.doc_id, r.removed, r.n_words, r.start) for r in rows)
    # The first two runs of 50 words stay, at the places 0 and 1 of text 1; all else goes, in one span a text.
    assert got == [(1, False, 51, 0), (1, True, 7998, 8), (2, True, 8000, 0), (3, True, 200, 720)]
    kept = {r.doc_id: r.text for r in substring_dedup.remove_pieces(df).collect()}
    assert len(kept[1].split()) < 60 and kept[2] == "" and kept[3].split() == ["other", "words"] * 60 and kept[4] == texts[4]


def test_removal_takes_passages_too_and_leaves_no_shared_run(spark):
    draw = random.Random(21)
    word = lambda: "".join(draw.choice("abcdefghé") for _ in range(4))
    passages = [[word() for _ in range(n)] for n in (55, 70, 120)]
    docs = []
    for i in range(25):
        said = []
        for p in draw.sample(passages, draw.randrange(0, 4)):
            said += [word() for _ in range(draw.randrange(5, 60))] + p
        said += [word() for _ in range(20)]
        n = draw.choice([8, 30, 1000])
        docs.append((i, "\n".join(" ".join(said[k : k + n]) for k in range(0, len(said), n))))
    df = spark.createDataFrame([*docs, (None, docs[0][1]), (90, None), (91, "")], "doc_id long, text string").repartition(3)
    left = {r.doc_id: r.text for r in substring_dedup.remove_pieces(df).collect()}
    assert not brute_passages([(i, left[i]) for i, _ in docs], 50) and brute_passages(docs, 50)
    for i, t in docs:  # what no document shares is all there, in order
        gone = {p for d, p, removed in brute_passages(docs, 50) if d == i and removed}
        assert split_words(left[i]) == [w for p, w in enumerate(split_words(t)) if p not in gone]
    assert left[None] == docs[0][1] and left[90] is None and left[91] == ""


def test_pieces_tell_their_kind(spark):
    line = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, line), (2, line)], "doc_id long, text string")
    assert sorted((r.kind, r.doc_id, r.removed) for r in substring_dedup.repeated_pieces(df).collect()) == [(k, i, i == 2) for k in ("paragraph", "passage") for i in (1, 2)]
