"""Periodic run detection: runs of words that repeat with a period, by a suffix automaton of each stretch that may hold one.

The automaton's states are merged from the longest to the shortest, each with the ordered set of places where its words end, the smaller set
into the larger. Two neighbours in a set that are new to each other, at a distance d not over the state's length, end a square of period d whose
left end is known exactly; squares are extended to the right to runs. Of squares with the same run the one with the least period tells.

Before that, a sound filter leaves out words that no run can hold: all pieces of a few words inside a run come again within a period.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.bytes_kit import buffers, shingles, slices, tidied, words
from lectern.llm.common import SPACE, col, map_arrow

#: A run has LEAST words and TIMES periods at least.
LEAST, TIMES = 6, 4
#: Places in a block of an ordered set.
BLOCK = 1024
RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_RUN_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


class Places:
    """An ordered set of numbers in blocks, so that adding one moves few others."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, x: int):
        self.blocks, self.firsts, self.size = [[x]], [x], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Put x in; its neighbours."""
        blocks = self.blocks
        k = max(0, bisect_right(self.firsts, x) - 1) if len(blocks) > 1 else 0
        block = blocks[k]
        i = bisect_right(block, x)
        before = block[i - 1] if i else blocks[k - 1][-1] if k else None
        after = block[i] if i < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else None
        block.insert(i, x)
        self.size += 1
        if not i:
            self.firsts[k] = x
        if len(block) > BLOCK:
            half = block[BLOCK // 2 :]
            del block[BLOCK // 2 :]
            blocks.insert(k + 1, half)
            self.firsts.insert(k + 1, half[0])
        return before, after


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[bool]]:
    """Length, suffix link and whether it is a prefix of all, of each state of the suffix automaton; state 0 is the empty one.

    A state's first step is kept in two flat lists, further ones in a dict that few states have.
    """
    length, link, own = [0], [-1], [False]
    word, to, more = [-1], [0], {}
    last = 0
    for i, w in enumerate(ids):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        own.append(True)
        word.append(-1)
        to.append(0)
        p, q = last, -1
        while p >= 0:
            if word[p] == w:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = w, new
            else:
                steps = more.get(p)
                if steps is None:
                    more[p] = {w: new}
                elif w in steps:
                    q = steps[w]
                    break
                else:
                    steps[w] = new
            p = link[p]
        if q >= 0:
            if length[p] + 1 < length[q]:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(False)
                word.append(word[q])
                to.append(to[q])
                if q in more:
                    more[copy] = dict(more[q])
                while p >= 0:
                    if word[p] == w:
                        if to[p] != q:
                            break
                        to[p] = copy
                    else:
                        steps = more.get(p)
                        if steps is None or steps.get(w) != q:
                            break
                        steps[w] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return length, link, own


def squares(ids: list[int]) -> set[tuple[int, int]]:
    """(start, period) of stretches that hold a square of that period and can't begin earlier; periods may be multiples of smaller ones."""
    length, link, own = automaton(ids)
    places: dict[int, Places] = {}
    found: set[tuple[int, int]] = set()

    def put(into: Places, x: int, n: int, known: int | None = None) -> None:
        before, after = into.add(x)
        if before is not None and before != known and x - before <= n:
            found.add((before - n + 1, x - before))
        if after is not None and after - x <= n:
            found.add((x - n + 1, after - x))

    for s in np.argsort(-np.array(length), kind="stable").tolist()[:-1]:
        mine = places.pop(s, None)
        if own[s]:
            if mine is None:
                mine = Places(length[s] - 1)
            else:
                put(mine, length[s] - 1, length[s])
        parent = link[s]
        if not parent:
            continue
        there = places.get(parent)
        if there is None:
            places[parent] = mine
            continue
        if there.size < mine.size:
            places[parent], there, mine = mine, mine, there
        n, known = length[parent], None
        for x in mine:  # in order, so the one before it here isn't new to it
            put(there, x, n, known)
            known = x
    return found


def runs_of(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words and `times` periods, 2 or more, by start, then period."""
    a, best = np.array(ids), {}
    for start, d in squares(ids):
        stop, step = start + d, 64
        while stop < len(a):
            part = a[stop : stop + step]
            other = np.flatnonzero(part != a[stop - d : stop - d + len(part)])
            if len(other):
                stop += int(other[0])
                break
            stop += len(part)
            step *= 2
        best[start, stop] = min(d, best.get((start, stop), d))
    return sorted((s, e - s, d) for (s, e), d in best.items() if e - s >= max(least, times * d))


def _parts(hashes: np.ndarray, at: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(first word, end) of stretches that hold all runs.

    With pieces of as many words as any run has beyond two periods, plus one, each piece in a run comes again one period before or after.
    """
    size = max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))
    grams, gram_at = shingles(hashes, at, size)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(gram_at))
    shift = np.repeat(at[:-1] - gram_at[:-1], np.diff(gram_at))
    live = np.arange(len(grams))
    while len(live):
        order = live[np.argsort(grams[live], kind="stable")]  # equal ones stay in the order of their places
        same = (grams[order[1:]] == grams[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        gap = np.where(same, np.diff(order), len(grams) + 1)
        near = np.full(len(grams), len(grams) + 1)
        near[order[1:]] = gap
        near[order[:-1]] = np.minimum(near[order[:-1]], gap)
        left = live[near[live] <= len(grams)]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(left) > 1) | (doc[left[1:]] != doc[left[:-1]])])) if len(left) else left
        count = np.diff(np.concatenate([first, [len(left)]]))
        total = np.repeat(count + size - 1, count)
        left = left[(total >= least) & (near[left] * times <= total)]
        if len(left) == len(live):
            return [(int(left[f] + shift[left[f]]), int(left[f] + shift[left[f]] + n + size - 1)) for f, n in zip(first, count, strict=True)]
        live = left
    return []


def _batch(texts: pa.Array, least: int, times: int) -> tuple[list, list]:
    """The runs and the collapsed text of each text."""
    data, ends = buffers(texts)
    raw = data.tobytes()
    hashes, first, stop, at = words(data, ends, lower=False)
    found: dict[int, list] = {}
    for low, high in _parts(hashes, at, least, times):
        d = int(np.searchsorted(at, low, "right")) - 1
        number: dict[bytes, int] = {}
        ids = [number.setdefault(raw[a:b], len(number)) for a, b in zip(first[low:high].tolist(), stop[low:high].tolist(), strict=True)]
        found.setdefault(d, []).extend((low - int(at[d]) + s, n, q) for s, n, q in runs_of(ids, least, times))
    runs, collapsed = [], []
    for d in range(len(ends) - 1):
        said, mine = raw[ends[d] : ends[d + 1]].split(), sorted(found.get(d, []), key=lambda r: (r[0], r[2]))
        if mine:
            keep = np.ones(len(said), bool)
            for s, n, q in mine:
                keep[s + q : s + n] = False
            said = [said[i] for i in np.flatnonzero(keep)]
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine])
        collapsed.append(b" ".join(said))
    return runs, collapsed


def find_runs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns keep of df (all by default) with runs and collapsed, a row for each row.

    Words are what white space separates, compared as they stand. A run is a stretch with smallest period q, of max(least, times * q) words
    or more, that no word beside it prolongs; runs may overlap. collapsed is the text's words, joined by one space, without those that
    a run holds after its first q. A null or empty text has no run and an empty collapsed text. A text is read whole in one task, whatever its
    length. Rows that repeat, or repeat an id, are dealt with each by itself; an empty table gives an empty one; columns with the new names are replaced.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("runs", "collapsed")]

    @tidied
    def run(batches):
        for batch in batches:
            for low, n in slices(batch.column(len(keep))):
                some = batch.slice(low, n)
                runs, collapsed = _batch(some.column(len(keep)), least, times)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:-1], pa.array(runs, _RUN_ARROW), pa.array(collapsed, pa.string())], names=[f"c{i}" for i in range(len(keep) + 2)]
                )

    schema = T.StructType([*[df.select(col(c)).schema[0] for c in keep], T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])
    return map_arrow(df.select(*map(col, keep), col(text_col)), run, schema)


def looped(text: Column, first: Column, period: Column) -> Column:
    """The text's words, joined by one space, with those from number first on replaced by a loop of the `period` words there; 0 <= first, 1 <= period."""
    said = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+"), F.lit(0))
    rest = F.size(said) - first
    loop = F.flatten(F.array_repeat(F.slice(said, first + 1, period), F.ceil(rest / period).cast("int")))
    return F.array_join(F.concat(F.slice(said, F.lit(1), first), F.slice(loop, F.lit(1), rest)), " ")


def n_words(text: Column) -> Column:
    """How many words white space separates; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+"))
