"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import collections
import difflib
import hashlib
import math
import re


def folded_words(text):
    return re.sub(r"[!-/:-@\[-`{-\x7f]", "", (text or "").lower()).split()


def removed(docs, match=50):
    """``{doc: (n_bytes, n_removed, n_spans, sha256 of the rest)}`` for ``[(doc_id, text)]``."""
    first, out = {}, {}
    for i, text in docs:
        body = (text or "").encode()
        for p in range(len(body) - match + 1):
            gram = body[p : p + match]
            first[gram] = min(first.get(gram, i), i)
    for i, text in docs:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - match + 1):
            if first[body[p : p + match]] < i:
                gone[p : p + match] = b"\1" * match
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        rest = bytes(b for b, g in zip(body, gone) if not g)
        out[i] = (len(body), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def shingle_counts(text):
    w = folded_words(text)
    return collections.Counter(zip(*(w[k:] for k in range(5))))


def similarity(a, b, weight):
    common = sum(min(a[g], b[g]) * weight(g) for g in a.keys() & b.keys())
    whole = sum(n * weight(g) for s in (a, b) for g, n in s.items()) - common
    return common / whole if whole else 1.0


def classes(docs, threshold, margin=0.0):
    """Smallest id of each document's class, by all pairs; also pairs within ``margin`` of the threshold."""
    counts = {i: shingle_counts(t) for i, t in docs}
    df = collections.Counter(g for s in counts.values() for g in s)
    weight = lambda g: math.log1p(len(docs) / df[g])
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    close = []
    same_words = {}
    for i, t in docs:
        lead = same_words.setdefault(tuple(folded_words(t)), i)
        root[max(find(i), find(lead))] = min(find(i), find(lead))
    by = collections.defaultdict(set)
    for i, s in counts.items():
        for g in s:
            by[g].add(i)
    pairs = {(a, b) for s in by.values() for a in s for b in s if a < b}
    for a, b in pairs:
        value = similarity(counts[a], counts[b], weight)
        if abs(value - threshold) <= margin:
            close.append((a, b))
        if value >= threshold:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}, close


def greedy_tiles(a, b, least=5):
    """Tiled words of ``b``: the longest common run of unmarked words, again and again."""
    a, b, total = list(a), list(b), 0
    while True:
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        if m.size < least:
            return total
        total += m.size
        a[m.a : m.a + m.size] = [object() for _ in range(m.size)]
        b[m.b : m.b + m.size] = [object() for _ in range(m.size)]
