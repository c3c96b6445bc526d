"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies. Shingles of five words are hashed into ``SLOTS`` slots, a vector
   of fixed size whatever the corpus, counted over all documents. A shingle's weight is
   its count in the document times ``ln(1 + documents / documents with its slot)``.
2. Sketch. For each of ``BANDS * ROWS`` hash functions the sample is drawn by Ioffe's
   improved consistent weighted sampling: two documents draw the same with a probability
   equal to their weighted Jaccard similarity. ``ROWS`` samples make one band key.
3. Documents with the same words are one, the smallest id; only those go on.
4. Candidates share a band key. First each document of a bucket is verified against the
   bucket's smallest id, which settles most of a large group with a comparison per member.
   Then every bucket that still holds several classes is compared in blocks of ``BLOCK``
   against ``BLOCK`` documents: sketches pick the documents that look like one of another
   class, and the exact similarities of those are computed in their task, which hands on a
   spanning forest of the links instead of all pairs. A bucket of any size is spread over
   its pairs of blocks, and none of its links is given up.
5. Verified pairs, by exact weighted Jaccard similarity, are joined to classes.

Hashes are 64 bits wide; the words of a document are identified by 128 bits. Sketch and
verification see whole texts. Texts are compared in lower case and without punctuation.

Defined results: texts without words, null or empty, are copies of each other; texts under
five words are equal only to texts of the same words; a row without ``doc_id`` can't be
named in a class and gets none; repeated rows are copies; different texts under one id are
documents of their own, each row in the class of its text, and a class takes the smallest id
of its rows; an empty table gives an empty result. ``first_of_classes`` keeps one row of each
class, that of the smallest id and, among rows of that id, of the smallest hash of the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapweave.llm.components import components
from gapweave.llm.textbytes import U, chunks, folded, mix64, powers, shingles, words
from gapweave.storage import materialize

WIDTH = 5
BANDS, ROWS = 10, 3
SLOT_BITS = 18
THRESHOLD = 0.8
ALIKE = 0.55
BLOCK = 256
_TABLE = 1 << 12


def _counts(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per text, sorted by text and shingle, with their counts."""
    order = np.lexsort((shingle, text))
    t, s = text[order], shingle[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return t[at], s[at], np.diff(np.append(at, len(t)))


def _slot(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> U(64 - SLOT_BITS)).astype(np.int64)


def slot_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents per slot, and their number in the last place: ``2**SLOT_BITS + 1`` counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SLOT_BITS) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, _, data, at in chunks(batch.column(0)):
                word, text = words(*folded(data, at))
                h, t, _ = shingles(word, text, WIDTH)
                _, s, _ = _counts(t, h)
                total[:-1] += np.bincount(_slot(s), minlength=1 << SLOT_BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    sums = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << SLOT_BITS) + 1, np.int64)
    out[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return out


def idf_of(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts[-1] / np.maximum(counts[:-1], 1)).astype(np.float64)


class Sampler:
    """Draws of improved consistent weighted sampling for many texts at once.

    Gamma(2, 1) variates come from tables of ``_TABLE`` draws, picked by bits of the
    shingle's hash under the given function, so equal shingles always get equal variates.
    """

    def __init__(self, functions: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2.0, 1.0, (functions, _TABLE))
        self.log_c = np.log(rng.gamma(2.0, 1.0, (functions, _TABLE)))
        self.odd = rng.integers(0, 1 << 63, functions, dtype=np.int64).astype(U) * U(2) + U(1)

    def draw(self, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One row of sample hashes per text; ``text`` is sorted, 0, 1, 2 ... without gaps."""
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        log_w = np.log(weight)
        out = np.empty((len(starts), len(self.odd)), U)
        for k, odd in enumerate(self.odd):
            m = shingle * odd
            m ^= m >> U(29)
            r = self.r[k][m & U(_TABLE - 1)]
            beta = ((m >> U(12)) & U(0xFFFFFF)).astype(np.float64) * 2.0**-24
            t = np.floor(log_w / r + beta)
            score = self.log_c[k][m >> U(52)] - r * (t - beta + 1)
            least = np.minimum.reduceat(score, starts)
            hit = np.flatnonzero(score == least[text])
            first = hit[np.flatnonzero(np.diff(text[hit], prepend=-1))]
            out[:, k] = mix64(shingle[first] ^ mix64(t[first].astype(np.int64).view(U)))
        return out


def _sketches(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(BANDS * ROWS)
        mixer = powers(ROWS)
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, at in chunks(batch.column(1)):
                n = end - first
                word, text = words(*folded(data, at))
                bounds = np.searchsorted(text, np.arange(n + 1))
                place = np.arange(len(word)) - bounds[text]
                longest = int(np.diff(bounds).max()) + 1
                keys = []
                for base in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)):
                    part = np.concatenate(([U(0)], np.cumsum(word * powers(longest, base)[place], dtype=U)))
                    keys.append(mix64((part[bounds[1:]] - part[bounds[:-1]]) + np.diff(bounds).astype(U) * base).view(np.int64))
                h, t, _ = shingles(word, text, WIDTH)
                t, s, tf = _counts(t, h)
                weight = tf * idf[_slot(s)]
                have, dense = np.unique(t, return_inverse=True)
                sig = sampler.draw(dense, s, weight) if len(have) else np.zeros((0, BANDS * ROWS), U)
                bands = np.empty((len(have), BANDS), np.int64)
                for b in range(BANDS):
                    bands[:, b] = mix64((sig[:, b * ROWS : (b + 1) * ROWS] * mixer).sum(axis=1, dtype=U) + U(b)).view(np.int64)
                total = np.bincount(t, weights=weight, minlength=n).astype(np.float64)
                count = np.zeros(n + 1, np.int64)
                count[1:][have] = 1
                lists = lambda rows, width, kind: pa.ListArray.from_arrays(
                    pa.array((np.cumsum(count) * width).astype(np.int32)), pa.array(rows.reshape(-1), kind)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, n),
                        batch.column(2).slice(first, n),
                        pa.array(keys[0]),
                        pa.array(keys[1]),
                        pa.array(total),
                        lists(bands, BANDS, pa.int64()),
                        lists((sig >> U(33)).astype(np.int32), BANDS * ROWS, pa.int32()),
                    ],
                    names=["doc_id", "mark", "key_a", "key_b", "weight", "bands", "sig"],
                )

    return run


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, at in chunks(batch.column(1)):
            word, text = words(*folded(data, at))
            h, t, _ = shingles(word, text, WIDTH)
            t, s, tf = _counts(t, h)
            cut = np.searchsorted(t, np.arange(end - first + 1))
            tf = tf.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, end - first),
                    pa.array([s[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array([tf[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                ],
                names=["doc_id", "shingles", "counts"],
            )


def weighted_jaccard(a, b, idf: np.ndarray) -> float:
    """Similarity of two ``(sorted shingles, counts)``."""
    (sa, ca), (sb, cb) = a, b
    if not len(sa) or not len(sb):
        return float(len(sa) == len(sb))
    at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    same = sb[at] == sa
    wa, wb = ca * idf[_slot(sa)], cb * idf[_slot(sb)]
    common = np.minimum(wa[same], wb[at[same]]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def _similar(idf: np.ndarray, threshold: float):
    read = lambda x, y: (np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, ca, sb, cb = batch.columns
            value = [
                weighted_jaccard(read(sa[i], ca[i]), read(sb[i], cb[i]), idf) >= threshold for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(value, pa.bool_())], names=["a", "b", "same"])

    return run


def _alike(one: str, other: str):
    """Share of equal samples of two sketches, an estimate of the similarity."""
    equal = F.zip_with(one, other, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda s, x: s + x) / float(BANDS * ROWS)


PLACE = ("band", "lo", "hi")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of one pair of blocks after the other; they arrive sorted by ``PLACE``."""
    now, parts = None, []
    for batch in batches:
        keys = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
        cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else []
        for a, b in zip(cut, [*cut[1:], len(keys)]):
            key = tuple(keys[a].tolist())
            if key != now and parts:
                yield now, pa.Table.from_batches(parts)
                parts = []
            now = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield now, pa.Table.from_batches(parts)


def _lookalikes(threshold: float):
    """Documents of a pair of blocks whose sketch is like that of one of another class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in _groups(batches):
            root, weight = table.column("root").to_numpy(), table.column("weight").to_numpy()
            sig = np.array(table.column("sig").combine_chunks().flatten()).reshape(len(root), -1)
            equal = np.zeros((len(root), len(root)), np.int16)
            for k in range(sig.shape[1]):
                equal += sig[:, k, None] == sig[None, :, k]
            # the common weight is the lesser of two at most, so a link needs weights in the threshold's ratio
            fits = np.minimum.outer(weight, weight) >= np.maximum.outer(weight, weight) * (threshold * 0.999999)
            hit = (fits & (equal >= ALIKE * sig.shape[1]) & (root[:, None] != root[None, :])).any(axis=1)
            if hit.any():
                yield from table.filter(pa.array(hit)).select([*PLACE, "doc_id", "root"]).to_batches()

    return run


def _links(idf: np.ndarray, threshold: float):
    """Links between documents of different classes in a pair of blocks, as a forest."""

    def adjacency(vectors) -> np.ndarray:
        n = len(vectors)
        if n <= 4:
            near = np.zeros((n, n), bool)
            for i in range(n):
                for j in range(i):
                    near[i, j] = near[j, i] = weighted_jaccard(vectors[i], vectors[j], idf) >= threshold
            return near
        # a shingle that occurs c times is c features, so that common counts add up
        times = np.concatenate([c for _, c in vectors]).astype(np.int64)
        shingle = np.repeat(np.concatenate([s for s, _ in vectors]), times)
        nth = np.arange(len(shingle)) - np.repeat(np.cumsum(times) - times, times)
        owner = np.repeat(np.arange(n), [int(c.sum()) for _, c in vectors])
        weight = idf[_slot(shingle)]
        total = np.bincount(owner, weights=weight, minlength=n)
        feature = np.where(nth > 0, mix64(shingle ^ mix64(nth.astype(U))), shingle)
        _, column, count = np.unique(feature, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column, weight = owner[shared], column[shared], np.sqrt(weight[shared])
        order = np.argsort(column, kind="stable")
        owner, column, weight = owner[order], column[order], weight[order]
        column = np.cumsum(np.diff(column, prepend=column[:1]) != 0) if len(column) else column
        common, wide = np.zeros((n, n)), 2048
        cut = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + wide, wide))
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            slab = np.zeros((n, wide))
            slab[owner[a:b], column[a:b] - k * wide] = weight[a:b]
            common += slab @ slab.T
        return common >= threshold * (total[:, None] + total[None, :] - common) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _groups(batches):
            ids, root = table.column("doc_id").to_numpy(), table.column("root").to_numpy()
            raw = zip(table.column("shingles").to_pylist(), table.column("counts").to_pylist())
            near = adjacency([(np.frombuffer(s, U), np.frombuffer(c, np.uint32)) for s, c in raw])
            near |= root[:, None] == root[None, :]  # known already; their links are not sent again
            todo, a, b = np.ones(len(ids), bool), [], []
            for start in range(len(ids)):
                if not todo[start]:
                    continue
                todo[start], queue = False, [start]
                while queue:
                    i = queue.pop()
                    new = np.flatnonzero(near[i] & todo)
                    todo[new] = False
                    queue += new.tolist()
                    for j in new[root[new] != root[i]]:
                        a.append(min(ids[i], ids[j])), b.append(max(ids[i], ids[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """``(doc_id, mark, class, class_id)`` per row of ``docs (doc_id, text, mark)``, whose ids are known.

    ``mark`` tells apart the rows of one id. A node is a set of rows with the same words; it has
    a number of its own, as one id may belong to several.
    """
    idf = idf_of(slot_frequencies(docs))
    sketch = materialize(
        docs.mapInArrow(
            _sketches(idf),
            "doc_id long, mark long, key_a long, key_b long, weight double, bands array<long>, sig array<int>",
        )
    )
    lead = sketch.groupBy("key_a", "key_b").agg(F.min(F.struct("doc_id", "mark")).alias("lead"))
    # numbers are given as the table is written, so every reading of it sees the same
    first = materialize(
        lead.select(
            "key_a",
            "key_b",
            F.monotonically_increasing_id().alias("node"),
            F.col("lead.doc_id").alias("first"),
            F.col("lead.mark").alias("first_mark"),
        )
    )
    known = sketch.select("doc_id", "mark", "key_a", "key_b").join(first, ["key_a", "key_b"])
    known = known.select("doc_id", "mark", "node", "first")
    # from here to the end ``doc_id`` is the number of a node
    sole = materialize(
        sketch.where(F.size("bands") > 0)
        .join(first, ["key_a", "key_b"])
        .where("doc_id = first AND mark = first_mark")
        .select(F.col("node").alias("doc_id"), "weight", "bands", "sig")
        .dropDuplicates(["doc_id"])
    )
    spots = sole.select("doc_id", F.explode("bands").alias("band"))
    shared = materialize(
        spots.groupBy("band").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    spots = materialize(spots.join(shared.select("band", "lead"), "band"))
    members = materialize(spots.select("doc_id").distinct())
    seen = sole.select("doc_id", "weight", "sig").join(members, "doc_id")
    seen = materialize(seen)
    named = first.select(F.col("node").alias("member"), F.col("first").alias("doc_id"), F.col("first_mark").alias("mark"))
    named = named.join(members.select(F.col("doc_id").alias("member")), "member")
    vectors = materialize(
        docs.join(named, ["doc_id", "mark"])
        .select(F.col("member").alias("doc_id"), "text")
        .mapInArrow(_vectors, "doc_id long, shingles binary, counts binary")
        .dropDuplicates(["doc_id"])
    )

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: vectors.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}"), F.col("counts").alias(f"c{c}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "ca", "sb", "cb")
        return materialize(both.mapInArrow(_similar(idf, threshold), "a long, b long, same boolean"))

    def looks(c: str) -> DataFrame:
        return seen.select(F.col("doc_id").alias(c), F.col("weight").alias(f"w{c}"), F.col("sig").alias(f"g{c}"))

    # a link needs weights in the ratio of the threshold: the common part is the lesser at most
    plausible = (F.least("wa", "wb") >= F.greatest("wa", "wb") * threshold * 0.999999) & (_alike("ga", "gb") >= ALIKE)
    pairs = spots.where("lead < doc_id").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    tried = verified(pairs.join(looks("b"), "b").join(looks("a"), "a").where(plausible).select("a", "b"))
    links = tried.where("same").select("a", "b")
    roots = components(links)
    label = members.join(roots, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("root")
    )
    here = materialize(spots.select("band", "doc_id").join(label, "doc_id"))
    several = materialize(
        here.groupBy("band")
        .agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        .where("x != y")
        .select("band", "parts")
    )
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    beside = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("beside")
    spread = here.join(several, "band").select("band", "doc_id", "root", own.alias("own"), beside)
    spread = spread.select("band", F.least("own", "beside").alias("lo"), F.greatest("own", "beside").alias("hi"), "doc_id", "root")
    dealt = lambda df: df.repartition(*PLACE).sortWithinPartitions(*PLACE)
    alike = materialize(
        dealt(spread.join(seen, "doc_id").select(*PLACE, "doc_id", "root", "weight", "sig")).mapInArrow(
            _lookalikes(threshold), "band long, lo int, hi int, doc_id long, root long"
        )
    )
    more = dealt(alike.join(vectors, "doc_id").select(*PLACE, "doc_id", "root", "shingles", "counts")).mapInArrow(
        _links(idf, threshold), "a long, b long"
    )
    roots = materialize(components(links.union(more)))
    ids = first.select(F.col("node").alias("id"), "first")
    smallest = roots.join(ids, "id").groupBy("root").agg(F.min("first").alias("class_id"))
    linked = roots.join(smallest, "root").select(F.col("id").alias("node"), "root", "class_id")
    return known.join(linked, "node", "left").select(
        "doc_id", "mark", F.coalesce("root", "node").alias("class"), F.coalesce("class_id", "first").alias("class_id")
    )


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id)`` per row of ``docs``; ``class_id`` is the smallest id of the class."""
    nameless = docs.where("doc_id is null").select(*(F.lit(None).cast("long").alias(c) for c in ("doc_id", "class_id")))
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")
    )
    return _classes(rows, threshold).select("doc_id", "class_id").unionByName(nameless)


def first_of_classes(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates; rows without id are all kept."""
    columns, key, mark = docs.columns, "_id", "_mark"
    while key in columns or mark in columns:
        key, mark = f"_{key}", f"_{mark}"
    rows = docs.where("doc_id is not null").withColumns(
        {key: F.col("doc_id").cast("long"), mark: F.xxhash64(*sorted(columns))}
    )
    classes = _classes(rows.select(F.col(key).alias("doc_id"), "text", F.col(mark).alias("mark")), threshold)
    kept = classes.groupBy("class").agg(F.min(F.struct("doc_id", "mark")).alias("lead"))
    kept = materialize(kept.select(F.col("lead.doc_id").alias(key), F.col("lead.mark").alias(mark)))
    # rows of the same id and mark are equal, so it doesn't matter which of them stays
    one = rows.join(kept, [key, mark], "left_semi").dropDuplicates([key, mark]).select(*columns)
    return one.unionByName(docs.where("doc_id is null"))
