"""Plain versions of what the operators compute."""

import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, size=5):
    w = split_words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(sets):
    """{id: smallest id reachable} by links of similarity 3/4 or more."""
    ids = sorted(sets)
    lead = {i: i for i in ids}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((find(a), find(b)))
                lead[v] = u
    return {i: find(i) for i in ids}
