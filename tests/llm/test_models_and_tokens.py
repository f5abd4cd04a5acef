import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, bytes_kit, language_id, quality, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})
ENCODER = byte_bpe.Encoder(PATH, public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="abct hes'rnl\n  é中1234!?-_*", max_size=200)))
def test_ids_are_tiktokens(text):
    ids = ENCODER.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


def test_both_ways_of_replay_agree(monkeypatch):
    draw = np.random.default_rng(3)
    words = [bytes(draw.choice(list(b"abcdet !*inrsh"), draw.integers(1, 14))) for _ in range(4000)] + [b"a" * 999, b"ab" * 700, bytes(range(256))]
    fast = byte_bpe.replay(words, PATH)
    monkeypatch.setattr(byte_bpe, "MANY", 1 << 60)
    assert byte_bpe.replay(words, PATH) == fast
    assert all(np.frombuffer(x, "<u4").tolist() == TIKTOKEN._core_bpe.encode_single_piece(w) for w, x in zip(words[::9], fast[::9], strict=True))


def test_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_WORDS", 5)
    own = byte_bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for t in ("one two three four five six seven", "eight nine", "one ten"):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == TIKTOKEN.encode_ordinary(t)
    assert len(own.known) <= 5


def test_encode_tables(spark, odd_docs, no_docs):
    out = byte_bpe.encode(odd_docs, PATH, public_tokenizers.PATTERN, keep=["doc_id", "`odd.name"]).collect()
    texts = sorted(((r.text or "") for r in odd_docs.collect()))
    assert sorted(bytes(r.decoded).decode() for r in out) == texts
    assert all(r.n_tokens == len(r.ids) and list(r.ids) == TIKTOKEN.encode_ordinary(bytes(r.decoded).decode()) for r in out)
    assert byte_bpe.encode(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([([31373],), (None,), ([],)], "ids array<int>")
    assert [r.text for r in byte_bpe.decode(ids, PATH).collect()] == ["hello", None, ""]


def test_encode_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op5_byte_bpe(spark, sf_dir).collect():
        ids = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    out = queries.op4_quality_classifier(spark, folder)
    labelled = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labelled)
    held = [r for r in labelled if r.held_out]
    assert len(held) > 40 and np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert np.mean([r.predicted for r in held if r.quality == 1]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in labelled)


def test_quality_features_by_hand():
    owner, bucket, value = quality.features(pa.array(["Ab ab!!", None, "", "  ", "ab Ab!!"]))
    assert set(owner.tolist()) == {0, 4}
    assert all(abs((value[owner == d] ** 2).sum() - 1) < 1e-5 for d in (0, 4))
    alone = quality.features(pa.array(["Ab ab!!"]))
    assert alone[1].tolist() == bucket[owner == 0].tolist()  # a text's features don't depend on its neighbours


def test_quality_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (7, None), (None, 1), (8, 1), (9, 1)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    out = quality.score(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    nothing = quality.train(odd_docs, labels.limit(0))
    assert {r.score for r in quality.score(odd_docs, nothing).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0 and quality.keep_good(odd_docs, model).columns == odd_docs.columns


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    out = queries.op8_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 250 and np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)


def test_language_gradients():
    draw = np.random.default_rng(1)
    windows, labels = draw.integers(1, 256, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    model = language_id.fit(windows, labels, ["a", "b"], epochs=1)
    for p in model.parameters():
        p.setflags(write=True)

    def loss():
        p = model.probabilities(windows, (np.concatenate([model.embed @ k[o * language_id.EMBED : (o + 1) * language_id.EMBED] for w, k in zip(language_id.WIDTHS, model.filters, strict=True) for o in range(w)], axis=1), model.biases))
        return -np.log(p[np.arange(5), labels]).mean()

    for p, g in zip(model.parameters(), language_id._gradients(model, windows, labels), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, step = p[at], 1e-2
        p[at] = was + step
        up = loss()
        p[at] = was - step
        down = loss()
        p[at] = was
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_language_on_odd_rows(odd_docs, no_docs):
    model = language_id.train(odd_docs.withColumn("lang", F.coalesce("lang", F.lit("xx"))))
    got = {r.doc_id: r for r in language_id.predict(odd_docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 10)] == ["und"] * 4 and got[10].score == 0
    assert got[9].lang_pred != "und" and got[5].lang_pred in model.languages
    assert language_id.predict(no_docs, model).count() == 0
    blank = language_id.train(no_docs)
    assert blank.languages == ["und"] and {r.lang_pred for r in language_id.predict(odd_docs, blank).collect()} == {"und"}


def test_quality_features_stop_at_the_text():
    texts = ["hello world", " next", "one two", "three", "", "Four", " five! six"]
    alone = [[x.tolist() for x in quality.features(pa.array([t]))[1:]] for t in texts]
    for some in (texts, [x for t in texts for x in (t, "zebra")], [x for t in texts for x in (t, "\t")]):
        owner, bucket, value = quality.features(pa.array(some))
        step = len(some) // len(texts)
        for i, want in enumerate(alone):
            assert [bucket[owner == i * step].tolist(), value[owner == i * step].tolist()] == want


def test_quality_scores_are_those_of_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: (r.score, r.held_out, r.predicted) for r in queries.op4_quality_classifier(spark, sf_dir).collect()}
    assert set(scores) == set(texts)
    for i, text in texts.items():
        _, bucket, value = quality.features(pa.array([text or ""]))
        want = 1 / (1 + np.exp(-np.clip(float((model.weights[bucket].astype(float) * value).sum()) + model.bias, -30, 30)))
        assert abs(scores[i][0] - want) < 1e-6 and scores[i][1] == (zlib.crc32(str(i).encode()) % 5 == 0) and scores[i][2] == int(scores[i][0] >= 0.3)


def test_decode_replaces_a_column_of_that_name(spark):
    ids = spark.createDataFrame([([31373], "old", 1), (None, "old", 2)], "ids array<int>, TEXT string, `a.b` int")
    out = byte_bpe.decode(ids, PATH)
    assert out.columns == ["ids", "a.b", "text"] and [r.text for r in out.collect()] == ["hello", None]


def test_other_operators_forget_the_encoder():
    byte_bpe.encoder(PATH, public_tokenizers.PATTERN).encode(["some words"])
    assert byte_bpe.encoder.cache_info().currsize
    list(bytes_kit.tidied(lambda batches: iter(batches))([]))
    assert not byte_bpe.encoder.cache_info().currsize and not byte_bpe.load_ranks.cache_info().currsize
