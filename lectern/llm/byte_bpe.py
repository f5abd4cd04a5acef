"""Byte-level BPE encoding and decoding by replaying the merges over the distinct words of a corpus.

The words that the pattern splits off are collected once each. An inverted index takes each
mergeable pair's rank to the positions, in all new words, where it stands; the lowest rank is merged
everywhere at once, left to right, and only the pairs beside a merge change. In each word that is the
order in which a merge of its own lowest pair would go, so the ids are those of the tiktoken
library. A task keeps the words it has met in a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.bytes_kit import CACHES, release_memory, slices
from lectern.llm.common import bound_batches, col, fresh, map_arrow, plain_names

#: Bytes of text whose new words are merged together, and words and bytes of words a task remembers.
PIECE, MOST_WORDS, MOST_BYTES = 1 << 22, 300_000, 32 << 20
#: From so many bytes of new words on, whole arrays are faster than single positions.
MANY = 20_000


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _merges(path: str) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """The rank of each mergeable pair of ids, the ids of single bytes, and the ranks of pairs of those (-1: none)."""
    ranks = load_ranks(path)
    pairs: dict[int, int] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                pairs[a << 32 | b] = rank
    single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
    first = np.full((256, 256), -1, np.int64)
    for i in range(256):
        for j in range(256):
            first[i, j] = ranks.get(bytes([i, j]), -1)
    return pairs, single, first


@lru_cache(maxsize=2)
def _codes(path: str) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """The mergeable pairs as sorted codes with their ranks, and the codes of each rank."""
    pairs = _merges(path)[0]
    codes = np.fromiter(pairs, np.int64, len(pairs))
    order = np.argsort(codes)
    of_rank: dict[int, list[int]] = {}
    for code, rank in pairs.items():
        of_rank.setdefault(rank, []).append(code)
    return codes[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order], of_rank


def _ranked(a: np.ndarray, b: np.ndarray, codes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rank of each pair of ids; -1 where either is no id or the pair doesn't merge."""
    out = np.full(len(a), -1, np.int64)
    both = np.flatnonzero((a >= 0) & (b >= 0))
    if len(both) and len(codes):
        code = a[both] << 32 | b[both]
        spot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        out[both] = np.where(codes[spot] == code, ranks[spot], -1)
    return out


def _by_rank(at: np.ndarray, ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The positions of each rank, in order."""
    order = np.argsort(ranks, kind="stable")
    found, starts = np.unique(ranks[order], return_index=True)
    return list(zip(found.tolist(), np.split(at[order], starts[1:]), strict=True)) if len(at) else []


def _replay_arrays(token: np.ndarray, following: np.ndarray, previous: np.ndarray, ranked: np.ndarray, path: str) -> None:
    """All merges, the positions of a rank at a time in whole arrays."""
    codes, ranks, of_rank = _codes(path)
    start = np.flatnonzero(ranked >= 0)
    index = {r: [p] for r, p in _by_rank(start, ranked[start])}
    order = list(index)
    heapq.heapify(order)
    while order:
        rank = heapq.heappop(order)
        at = np.unique(np.concatenate(index.pop(rank)))
        a, right = token[at], following[at]
        code = a << 32 | token[right]
        fits = np.zeros(len(at), bool)
        for c in of_rank[rank]:
            fits |= code == c
        fits &= (a >= 0) & (token[right] >= 0)
        at, right = at[fits], right[fits]
        if not len(at):
            continue
        chained = np.zeros(len(at), bool)
        chained[1:] = at[1:] == right[:-1]
        if chained.any():  # of overlapping pairs every other one, from the left
            heads = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            fits = (np.arange(len(at)) - heads) % 2 == 0
            at, right = at[fits], right[fits]
        after = following[right]
        token[at], token[right] = rank, -2
        following[at] = after
        previous[after] = at
        left = previous[at]
        for x, y in ((at, after), (left[left >= 0], at[left >= 0])):
            new = _ranked(token[x], token[y], codes, ranks)
            low = new >= 0
            for r, p in _by_rank(x[low], new[low]):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(order, r)


def replay(words: list[bytes], path: str) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers. A word that is a token as it stands is that token."""
    ranks = load_ranks(path)
    pairs, single, first = _merges(path)
    out: list[bytes | None] = [None if (r := ranks.get(w)) is None else r.to_bytes(4, "little") for w in words]
    rest = [i for i, ids in enumerate(out) if ids is None]
    if not rest:
        return out
    # One array of positions for all words; a -1 closes each word, in both directions.
    lengths = np.array([len(words[i]) for i in rest])
    heads = np.concatenate([[0], np.cumsum(lengths + 1)])
    raw = np.zeros(heads[-1], np.uint8)
    inside = np.ones(heads[-1], bool)
    inside[heads[1:] - 1] = False
    raw[inside] = np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)
    ids = np.where(inside, single[raw], -1)
    if (ids[inside] < 0).any():
        raise ValueError("the vocabulary lacks a byte")
    ranked = np.where(inside[:-1] & inside[1:], first[raw[:-1], raw[1:]], -1)
    following = np.arange(1, len(ids) + 1)
    previous = np.arange(-1, len(ids) - 1)
    if len(ids) >= MANY:
        _replay_arrays(ids, following, previous, ranked, path)
    else:
        ids = _replay_lists(ids.tolist(), following.tolist(), previous.tolist(), ranked, pairs)
    live = ids[ids != -2]
    ends = np.flatnonzero(live == -1) * 4
    raw = live.astype("<u4").tobytes()
    for i, low, high in zip(rest, [0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True):
        out[i] = raw[low:high]
    return out


def _replay_lists(token: list[int], following: list[int], previous: list[int], ranked: np.ndarray, pairs: dict[int, int]) -> np.ndarray:
    """All merges, a position at a time: less to set up for few words."""
    at = np.flatnonzero(ranked >= 0)
    index = {r: p.tolist() for r, p in _by_rank(at, ranked[at])}
    order = list(index)
    heapq.heapify(order)
    known = pairs.get
    while order:
        rank = heapq.heappop(order)
        positions = index.pop(rank)
        positions.sort()
        for at in positions:
            a = token[at]
            if a < 0:
                continue
            right = following[at]
            b = token[right]
            if b < 0 or known(a << 32 | b) != rank:
                continue
            token[at] = rank
            token[right] = -2
            after = following[at] = following[right]
            previous[after] = at
            for left, nxt in ((at, after), (previous[at], at)):
                if left >= 0 and (x := token[left]) >= 0 and (y := token[nxt]) >= 0 and (r := known(x << 32 | y)) is not None:
                    if r in index:
                        index[r].append(left)
                    else:
                        index[r] = [left]
                        heapq.heappush(order, r)
    return np.array(token, np.int64)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, pattern)


class Encoder:
    """Encodes texts by a vocabulary; remembers words within bounds."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.path, self.ranks = path, load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.size = 0
        self.tokens = np.empty(max(self.ranks.values(), default=-1) + 1, object)
        self.tokens[:] = b""
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.tokens = self.tokens.tolist()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        known = self.known
        new = [w for w in {w for ws in split for w in ws} if w not in known]
        raw = [w.encode() for w in new]
        for w, b, ids in zip(new, raw, replay(raw, self.path), strict=True):
            known[w] = ids
            self.size += len(b)
        out = [b"".join([known[w] for w in ws]) for ws in split]
        if len(known) > MOST_WORDS or self.size > MOST_BYTES:
            self.known, self.size = {}, 0
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


CACHES += [f.cache_clear for f in (encoder, load_ranks, _merges, _codes)]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """The columns `keep` (default: all but the text) with ids array<int>, n_tokens and decoded binary.

    digests=True returns, instead of ids and decoded, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers) and decoded_sha256, both computed where the text is read. A null text counts as
    empty and has no ids. `path` names the vocabulary on every executor. Columns of df with the
    new names are replaced. Long texts are encoded whole, rows that repeat each; an empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    keep = [c for c in (df.columns if keep is None else keep) if c != text_col and c.lower() not in new]
    kinds = [("n_tokens", pa.int64()), *zip(new[1:], [pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.binary()], strict=True)]

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, pattern)
        for texts in batches:
            done: list[list] = [[], [], []]
            for start, n in slices(texts, PIECE):
                for ids in own.encode([t or "" for t in texts.slice(start, n).to_pylist()]):
                    plain = own.decode(ids)
                    done[0].append(len(ids) // 4)
                    done[1].append(hashlib.sha256(ids).hexdigest() if digests else np.frombuffer(ids, "<i4"))
                    done[2].append(hashlib.sha256(plain).hexdigest() if digests else plain)
            yield pa.StructArray.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(done, kinds, strict=True)], fields=[pa.field(*k) for k in kinds])
        release_memory()

    (all_,) = fresh(df, "encoded_")
    wide = df.select(*map(col, dict.fromkeys([*keep, text_col]))).withColumn(all_, encoded(col(text_col).cast("string")))
    return wide.select(*map(col, keep), *[col(all_)[c].alias(c) for c in new])


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """df with the text of its ids; null ids give a null text, no ids an empty one, bytes that aren't UTF-8 the replacement character.

    A column of df named out_col is replaced, unless it holds the ids. Rows that repeat are decoded each; an empty table gives an empty result.
    """
    df = df.select(*[col(c) for c in df.columns if c.lower() != out_col.lower() or c == ids_col])
    kinds = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])
    place = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in load_ranks(path).items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(tokens[i] for i in ids).decode("utf-8", "replace") for ids in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=plain_names(batch.num_columns + 1))

    return map_arrow(df, run, kinds)
