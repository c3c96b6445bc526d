"""Removal of repeated byte strings with a partitioned suffix array.

A byte goes if it lies in a string of ``MATCH`` bytes that also starts in a document with a
smaller id. Only the first ``MATCH`` bytes of a suffix matter for that, and sending them for
every suffix would cost fifty times the text. So suffixes travel in runs:

1. The leading token of a suffix is, of the ``TOKEN``-byte strings within its first
   ``MATCH`` bytes, the one with the smallest hash. Equal prefixes have equal leading
   tokens. Consecutive suffixes with one leading token are a run and share their bytes.
2. A sample of documents gives splitters of the leading tokens, by which the runs are
   range-partitioned. A token so frequent that it would fill a bucket sends its suffixes
   singly instead, dealt by their ``MATCH`` bytes. Either way all suffixes with equal
   prefixes meet in one bucket, so no match lies across a boundary. Runs of equal bytes in
   one chunk of documents are sent once; the repeats are settled where they are.
3. A bucket drops tokens of one document and sorts the other suffixes by multikey
   quicksort, eight bytes as one key, going on only within groups that are still equal.
   Each group of equal prefixes yields its smallest document.
4. Covered stretches go back to their documents, are merged, and cut the text.

Defined results: null and empty texts have no bytes; texts under ``MATCH`` bytes lose
nothing; a null id is larger than any other but the largest number there is; rows of one id are never each other's smaller
document, each row is judged by its own text; an empty table gives an empty result.
Further columns are dropped by ``removed_spans``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from gapweave.llm.textbytes import U, chunks, mix64
from gapweave.storage import materialize

MATCH, TOKEN = 50, 16
REACH = MATCH - TOKEN + 1
BUCKET = 4 << 20  # bytes of text whose suffixes make a bucket
SAMPLE = 200_000  # runs in the sample, about
CHUNK = 2 << 20
LAST = (1 << 63) - 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORDS = (0, 42, 8, 32, 16, 24, 40)  # where the keys of a prefix begin: its ends first, as they differ soonest


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number."""
    x = data.astype(U)
    for step in (1, 2, 4):
        x = (x[:-step] << U(8 * step)) | x[step:]
    return x


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, first suffix, last suffix, token place)`` of each run, places in ``data``."""
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < MATCH:
        return none
    word = eights(data)
    h = word[:-8] * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h += word[8:] * U(0xA0761D6478BD642F)
    h = mix64(h)
    low = h
    for step in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: len(h) - REACH + 1], low[REACH - 32 : REACH - 32 + len(h) - REACH + 1])
    size = np.diff(offsets)
    fits = np.flatnonzero(size >= MATCH)
    valid = np.zeros(len(low) + 1, np.int8)
    np.add.at(valid, offsets[fits], 1)
    np.add.at(valid, offsets[fits + 1] - MATCH + 1, -1)
    inside = np.cumsum(valid)[:-1] > 0
    if not inside.any():
        return none
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (low[1:] != low[:-1])
    begin = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | (low[1:] != low[:-1])
    end = np.flatnonzero(stop)
    place = np.empty(len(begin), np.int64)
    for a in range(0, len(begin), 1 << 16):
        b = begin[a : a + (1 << 16)]
        place[a : a + len(b)] = b + h[b[:, None] + np.arange(REACH)].argmin(axis=1)
    return np.searchsorted(offsets, begin, "right") - 1, begin, end, place


def tokens(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of the sixteen bytes at each place."""
    if not len(place):
        return np.zeros(0, U), np.zeros(0, U)
    both = data[place[:, None] + np.arange(TOKEN)].view(">u8").astype(U)
    return both[:, 0], both[:, 1]


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many stretches, one after the other."""
    ends = np.cumsum(size)
    if not len(ends):
        return np.zeros(0, np.uint8)
    return data[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]


class Splitters:
    """Where a leading token goes, from a sample of tokens."""

    def __init__(self, one: np.ndarray, two: np.ndarray, buckets: int):
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        cut = (np.arange(1, buckets) * len(one)) // buckets if len(one) else np.zeros(0, np.int64)
        self.one, self.two, self.buckets = one[cut], two[cut], buckets
        new = np.flatnonzero(np.concatenate(([True], (np.diff(one) != 0) | (np.diff(two) != 0))) if len(one) else [])
        count = np.diff(np.append(new, len(one)))
        often = new[count > max(8, len(one) / (2 * buckets))]
        self.hot = {(int(a), int(b)) for a, b in zip(one[often], two[often])}
        self.hot_one = np.unique(one[often])

    def bucket(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        left, right = np.searchsorted(self.one, one), np.searchsorted(self.one, one, "right")
        for i in np.flatnonzero(right > left):
            left[i] += np.searchsorted(self.two[left[i] : right[i]], two[i], "right")
        return left

    def is_hot(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.zeros(len(one), bool)
        if self.hot:
            for i in np.flatnonzero(np.isin(one, self.hot_one)):
                out[i] = (int(one[i]), int(two[i])) in self.hot
        return out


def _string_hash(data, begin, size) -> np.ndarray:
    """A hash of each stretch, from running sums: a first sieve for equal ones."""
    value = mix64(data.astype(U) + U(1))
    base = U(0x9E3779B97F4A7C15)
    power = np.multiply.accumulate(np.concatenate(([U(1)], np.full(len(data), base))))
    back = np.multiply.accumulate(np.concatenate(([U(1)], np.full(len(data), U(pow(int(base), -1, 1 << 64))))))
    sums = np.concatenate(([U(0)], np.cumsum(value * power[:-1], dtype=U)))
    return (sums[begin + size] - sums[begin]) * back[begin] + size.astype(U)


def _settle(data, begin, size, doc, rank):
    """Runs of a chunk to send, and those equal to a run of a smaller document."""
    key = _string_hash(data, begin, size)
    order = np.lexsort((rank, key))
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    lead = np.empty(len(k), np.int64)
    lead[order] = first
    maybe = np.flatnonzero((lead != np.arange(len(k))) & (size == size[lead]) & (rank > rank[lead]))
    a, b = gathered(data, begin[maybe], size[maybe]), gathered(data, begin[lead[maybe]], size[maybe])
    at = np.concatenate(([0], np.cumsum(size[maybe])))
    wrong = np.concatenate(([0], np.cumsum(a != b)))
    done = maybe[wrong[at[1:]] == wrong[at[:-1]]]
    send = np.ones(len(k), bool)
    send[done] = False
    return np.flatnonzero(send), done


def _pack(ids, marks, doc, start, size, place, body) -> bytes:
    docs, local = np.unique(doc, return_inverse=True)
    head = np.array([len(docs), len(doc)], np.int64)
    parts = (head, ids[docs], marks[docs], local.astype(np.int32), start.astype(np.int32), size.astype(np.int32), place.astype(np.int32), body)
    return zstandard.ZstdCompressor(level=6).compress(b"".join(x.tobytes() for x in parts))


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)
    docs, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    at, out = 16, []
    for kind, count in ((np.int64, docs), (np.int32, docs), *[(np.int32, n)] * 4):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return (*out, np.frombuffer(raw, np.uint8, offset=at))


def _spans_by_doc(ids, marks, doc, start, end):
    """Rows ``(doc_id, mark, spans)`` with the spans of each document packed."""
    order = np.lexsort((start, doc))
    doc, pairs = doc[order], np.column_stack([start[order], end[order]]).astype(np.int32)
    cut = np.flatnonzero(np.diff(doc, prepend=-1) != 0)
    for a, b in zip(cut, np.append(cut[1:], len(doc))):
        yield int(ids[doc[a]]), int(marks[doc[a]]), pairs[a:b].tobytes()


def _rank(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The ids by which documents are smaller or larger: unknown ones come last."""
    return np.where(marks < 0, LAST, ids)


def _sender(split: Splitters):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            all_marks = batch.column(1).to_numpy(zero_copy_only=False)
            for first, end, data, at in chunks(batch.column(2), CHUNK):
                ids, marks = all_ids[first:end], all_marks[first:end]
                doc, begin, last, place = runs(data, at)
                if not len(doc):
                    continue
                size = last - begin + MATCH
                keep, done = _settle(data, begin, size, doc, _rank(ids, marks)[doc])
                rows = []
                for i, mark, spans in _spans_by_doc(ids, marks, doc[done], (begin - at[doc])[done], (begin - at[doc] + size)[done]):
                    rows.append((int(mix64(np.array([i], np.int64).view(U))[0] % U(split.buckets)), None, i, mark, spans))
                doc, begin, size, place = doc[keep], begin[keep], size[keep], place[keep]
                one, two = tokens(data, place)
                hot = split.is_hot(one, two)
                to = split.bucket(one, two)
                if hot.any():
                    n = size[hot] - MATCH + 1
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    each = np.repeat(begin[hot], n) + step
                    word = eights(data)
                    h = np.zeros(len(each), U)
                    for o in WORDS:
                        h = mix64(h ^ word[each + o])
                    doc = np.concatenate([doc[~hot], np.repeat(doc[hot], n)])
                    begin = np.concatenate([begin[~hot], each])
                    size = np.concatenate([size[~hot], np.full(len(each), MATCH)])
                    # by their own first bytes: no other suffix has this leading token
                    place = np.concatenate([place[~hot], each])
                    to = np.concatenate([to[~hot], (h % U(split.buckets)).astype(np.int64)])
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(split.buckets + 1))
                for b in np.flatnonzero(np.diff(cut)):
                    s = order[cut[b] : cut[b + 1]]
                    body = gathered(data, begin[s], size[s])
                    rows.append((int(b), _pack(ids, marks, doc[s], begin[s] - at[doc[s]], size[s], place[s] - begin[s], body), None, None, None))
                yield _record(rows)

    return send


_SENT = pa.schema([("bucket", pa.int32()), ("runs", pa.binary()), ("doc_id", pa.int64()), ("mark", pa.int32()), ("spans", pa.binary())])


def _record(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_SENT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)


def smallest_documents(data: np.ndarray, begin: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix, the smallest document among those with the same ``MATCH`` bytes.

    Multikey quicksort with eight-byte keys: a key sorts what the keys before left equal.
    """
    least = doc.copy()
    if not len(begin):
        return least
    word = eights(data)
    left, group = np.arange(len(begin)), np.zeros(len(begin), np.int64)
    for o in WORDS:
        key = word[begin[left] + o]
        order = np.argsort(key) if o == WORDS[0] else np.lexsort((key, group))
        left, key, group = left[order], key[order], group[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        group = np.cumsum(new)
        many = ~(new & np.append(new[1:], True))
        left, group = left[many], group[many]
        if not len(left):
            return least
    at = np.flatnonzero(np.diff(group, prepend=-1) != 0)
    best = np.minimum.reduceat(doc[left], at)
    least[left] = np.repeat(best, np.diff(np.append(at, len(left))))
    return least


def _bucket(blobs: list[bytes]):
    """Spans of a bucket's documents that smaller documents cover."""
    parts = []
    while blobs:
        parts.append(_unpack(blobs.pop()))
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    ids, marks = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    doc = np.concatenate([p[2].astype(np.int64) + base[i] for i, p in enumerate(parts)])
    start, size, place = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (3, 4, 5))
    body = np.concatenate([p[6] for p in parts])
    del parts
    begin = np.cumsum(size) - size
    who = _rank(ids, marks)[doc]
    one, two = tokens(body, begin + place)
    order = np.lexsort((two, one))
    new = np.flatnonzero(np.concatenate(([True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))))
    n = np.diff(np.append(new, len(order)))
    sole = np.minimum.reduceat(who[order], new) == np.maximum.reduceat(who[order], new)
    left = order[~np.repeat(sole, n)]
    if not len(left):
        return
    # equal runs become one, of the smallest document
    text, seen = body.tobytes(), {}
    string = np.array([seen.setdefault(text[a : a + s], len(seen)) for a, s in zip(begin[left].tolist(), size[left].tolist())])
    first = np.full(len(seen), LAST, np.int64)
    np.minimum.at(first, string, who[left])
    length = np.fromiter(map(len, seen), np.int64, len(seen))
    data = np.frombuffer(b"".join(seen), np.uint8)
    del text, seen, body
    at = np.cumsum(length) - length
    count = length - MATCH + 1
    owner = np.repeat(np.arange(len(length)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    covered = smallest_documents(data, at[owner] + step, first[owner]) < first[owner]
    # stretches of covered suffixes within each distinct run
    edge = covered.copy()
    edge[1:] &= ~covered[:-1] | (step[1:] == 0)
    stop = covered.copy()
    stop[:-1] &= ~covered[1:] | (step[1:] == 0)
    s0, s1 = np.flatnonzero(edge), np.flatnonzero(stop)
    cut = np.searchsorted(owner[s0], np.arange(len(length) + 1))
    whole = who[left] > first[string]
    some = left[~whole]
    n = (cut[string + 1] - cut[string])[~whole]
    pick = np.repeat(cut[string[~whole]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    d = np.concatenate([doc[left[whole]], np.repeat(doc[some], n)])
    a = np.concatenate([start[left[whole]], np.repeat(start[some], n) + step[s0[pick]]])
    b = np.concatenate([(start + size)[left[whole]], np.repeat(start[some], n) + step[s1[pick]] + MATCH])
    yield from _spans_by_doc(ids, marks, d, a, b)


def _receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition is a bucket: runs to sort, and spans that are settled already."""
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        kept = []
        for b, r, i, m, s in zip(*(c.to_pylist() for c in batch.columns)):
            if r is None:
                kept.append((b, None, i, m, s))
            else:
                blobs.setdefault(b, []).append(r)
        if kept:
            yield _record(kept)
    while blobs:
        b, runs_of = blobs.popitem()
        yield _record([(b, None, i, m, s) for i, m, s in _bucket(runs_of)])


def _merged(parts) -> np.ndarray:
    """Sorted, disjoint ``[start, end)`` from packed spans."""
    pairs = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in parts]).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate(([True], pairs[1:, 0] > reach[:-1]))
    at = np.flatnonzero(new)
    return np.column_stack([pairs[at, 0], np.append(reach[at[1:] - 1], reach[-1])])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, found = batch.columns
        size, spans, digests, kept = [], [], [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or b""
            parts = [x for x in found[i].as_py() or () if x]
            gone = _merged(parts) if parts else np.zeros((0, 2), np.int64)
            rest = b"".join(text[a:b] for a, b in zip([0, *gone[:, 1].tolist()], [*gone[:, 0].tolist(), len(text)]))
            size.append(len(text))
            spans.append([{"start": int(a), "end": int(b)} for a, b in gone])
            digests.append(hashlib.sha256(rest).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(digests, pa.string())],
            names=["doc_id", "n_bytes", "spans", "kept_sha256"],
        )


def removed_spans(docs: DataFrame, *, bucket_bytes: int = BUCKET, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, removed ``spans`` and the hash of what is left."""
    # rows are told apart by id and 31 bits of a hash; rows without id by 64 bits more, in place
    # of the id, and by a mark below zero
    mark = F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int")
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit(1))).alias("doc_id"),
        F.when(F.col("doc_id").isNull(), F.lit(-1) - mark).otherwise(mark).alias("mark"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"),
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    share = min(1.0, sample * (REACH + 1) / 2 / max(total, 1))
    picked = F.pmod(F.xxhash64("doc_id", "mark", F.lit(17)), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0), CHUNK):
                one, two = tokens(data, runs(data, at)[3])
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["one", "two"])

    # bounded: about ``sample`` runs, spread over documents by a hash of the id
    seen = keyed.where(picked).select("text").mapInArrow(look, "one long, two long").toArrow()
    one, two = (seen.column(c).to_numpy().astype(np.int64).view(U) for c in ("one", "two"))
    split = Splitters(one, two, buckets)
    sent = keyed.mapInArrow(_sender(split), "bucket int, runs binary, doc_id long, mark int, spans binary")
    dealt = sent.repartitionById(buckets, F.col("bucket"))
    spans = dealt.mapInArrow(_receive, "bucket int, runs binary, doc_id long, mark int, spans binary")
    found = spans.groupBy("doc_id", "mark").agg(F.collect_list("spans").alias("spans"))
    # the runs are several times the text: their shuffle files go as soon as the spans are written
    conf = docs.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        found = materialize(found)
    finally:
        conf.set(CLEANUP, before)
    return (
        keyed.join(found, ["doc_id", "mark"], "left")
        .select(F.when(F.col("mark") >= 0, F.col("doc_id")).alias("doc_id"), "text", "spans")
        .mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept_sha256 string")
    )
