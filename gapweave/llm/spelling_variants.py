"""Spelling variants: words one letter apart, grouped under the much more frequent form.

Words are vectors: how many of their code points fall into each of ``GROUPS`` letter groups.
A word one letter away has at most one surplus and one deficit over the whole vector. The
vectors form a trie, one level a group; searching it spends that budget of one surplus and one
deficit, and the words at the leaves reached are verified letter by letter.

The first levels of the trie are the partitioning: a word goes to the bucket of its own first
counts, and as a query to the later buckets that the budget reaches, so each pair meets once.
The depth is the smallest at which no bucket exceeds ``BUCKET`` words; buckets that exceed it
at full depth (words of the same counts throughout) are dealt to blocks by a hash, and their
queries go to each block. The remaining levels are a trie in memory, per bucket.

Defined results: null texts have no words; a document without id has the empty string for an
id in the checksum; repeated rows count again. Of equally frequent near words the smallest in
code-point order is the form. Tables without words give no rows. Further columns of the input
are not read. Texts are read whole, one at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gapweave.storage import materialize

SHORTEST = 7
LEAST = 2
RATIO = 10
MISSPELL = 31
GROUPS = 16
BUCKET = 1 << 15
OWN = -1  # the budget of a word in its own bucket, which comes before those of queries
FEW = 16  # leaves up to this size are verified as they are
HELD = 1 << 18  # counted words a task holds before it hands them on

# Fixed value: Latin letters by how frequent they are in prose, the most frequent first.
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"


def letter_group(c: str) -> int:
    """The most frequent letters have groups of their own; the rarest join them from behind."""
    place = BY_FREQUENCY.find(c)
    if place < 0:
        return ord(c) % GROUPS
    return place if place < GROUPS else 2 * GROUPS - 1 - place


def counts_of(word: str, group: dict[str, int]) -> str:
    """The word's letter-group counts, as one ASCII character a group; from 79 on they count as 79."""
    counts = [0] * GROUPS
    for c in word:
        g = group.get(c)
        if g is None:
            g = group[c] = letter_group(c)
        counts[g] += 1
    return "".join(chr(48 + min(n, 79)) for n in counts)


def word_counts(
    docs: DataFrame, *, shortest: int = SHORTEST, least: int = LEAST, misspell: int | None = MISSPELL
) -> DataFrame:
    """``(word, n, counts)`` of runs of letters in ``docs (doc_id, text)``, A to Z in lower case.

    With ``misspell`` the runs whose checksum with the document's id it divides lose one code
    point each. Words are counted in each task before they meet.
    """
    run_of_letters = f"[a-zÀ-ÿ]{{{shortest},}}"  # shorter runs can't become longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, group = re.compile(run_of_letters).findall, Counter(), {}

        def out() -> pa.RecordBatch:
            words = list(held)
            columns = [words, list(held.values()), [counts_of(w, group) for w in words]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["word", "n", "counts"])

        kinds = [pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # bytes change A to Z only
                words = Counter(find((text.as_py() or "").encode().lower().decode()))
                begun = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in words.items():
                    if misspell:
                        h = zlib.crc32(word.encode(), begun)
                        if h % misspell == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long, counts string")
    return counted.groupBy("word", "counts").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


class Leaf:
    """Words with the same counts; many are looked up by their halves.

    Two words one letter apart share what comes before the letter and what comes after it, so
    they share their first or their last ``half`` code points.
    """

    def __init__(self, words: list[tuple[str, int]]):
        self.words, self.half = words, max(0, (min(len(w) for w, _ in words) - 2) // 2)
        self.parts: dict[tuple[bool, str], list[tuple[str, int]]] = {}
        if len(words) > FEW:
            for w in words:
                self.parts.setdefault((True, w[0][: self.half]), []).append(w)
                self.parts.setdefault((False, w[0][len(w[0]) - self.half :]), []).append(w)

    def near(self, word: str) -> list[tuple[str, int]]:
        if not self.parts:
            return [w for w in self.words if one_apart(word, w[0])]
        some = self.parts.get((True, word[: self.half]), []) + self.parts.get((False, word[len(word) - self.half :]), [])
        return [w for w in set(some) if one_apart(word, w[0])]


def trie_of(words: list[tuple[str, int, bytes]], depth: int) -> dict | tuple[bytes, Leaf]:
    """Words ``(word, n, counts)`` by their counts from level ``depth`` on.

    An inner node maps a count to the node below; where only one leaf remains, the node is that
    leaf with its counts.
    """
    by_counts: dict[bytes, list[tuple[str, int]]] = {}
    for word, n, counts in words:
        by_counts.setdefault(counts, []).append((word, n))

    def build(leaves: list[tuple[bytes, Leaf]], level: int) -> dict | tuple[bytes, Leaf]:
        if len(leaves) == 1:
            return leaves[0]
        below: dict[int, list[tuple[bytes, Leaf]]] = {}
        for leaf in leaves:
            below.setdefault(leaf[0][level], []).append(leaf)
        return {n: build(some, level + 1) for n, some in below.items()}

    return build([(counts, Leaf(some)) for counts, some in by_counts.items()], depth)


def search(root: dict | tuple[bytes, Leaf], wanted: bytes, depth: int, surplus: int, deficit: int) -> list[Leaf]:
    """Leaves whose counts from ``depth`` on differ by the surplus and the deficit left, or less."""
    found, stack = [], [(root, depth, surplus, deficit)]
    while stack:
        node, level, more, less = stack.pop()
        if type(node) is tuple:
            counts, leaf = node
            if counts[level:] != wanted[level:]:
                for i in range(level, GROUPS):
                    by = counts[i] - wanted[i]
                    if by == 0:
                        continue
                    if by == 1 and more:
                        more = 0
                    elif by == -1 and less:
                        less = 0
                    else:
                        break
                else:
                    found.append(leaf)
            else:
                found.append(leaf)
            continue
        n = wanted[level]
        level += 1
        below = node.get(n)
        if below is not None:
            stack.append((below, level, more, less))
        if more and (below := node.get(n + 1)) is not None:
            stack.append((below, level, 0, less))
        if less and (below := node.get(n - 1)) is not None:
            stack.append((below, level, more, 0))
    return found


def reached(own: str) -> list[tuple[str, int]]:
    """Later buckets within the budget of a word in bucket ``own``, each with what is left of it.

    The rest is 2 for the surplus and 1 for the deficit.
    """
    found, depth = [], len(own)
    steps = [(i, s) for i in range(depth) for s in (1, -1)]
    for i, s in steps:
        for change in [((i, s),), *(((i, s), (j, -s)) for j in range(i + 1, depth))]:
            key = list(own)
            for at, by in change:
                key[at] = chr(ord(key[at]) + by)
            if min(key) >= "0" and "".join(key) > own:
                spent = sum(2 if by > 0 else 1 for _, by in change)
                found.append(("".join(key), 3 - spent))
    return found


def near_pairs(words: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """``(a, n_a, b, n_b)``: pairs of words of ``(word, n, counts)`` that are one letter apart, each once."""
    depths = F.explode(F.sequence(F.lit(0), F.lit(GROUPS))).alias("depth")
    sizes = words.select("counts", depths).groupBy("depth", F.expr("left(counts, depth)").alias("key")).count()
    largest = {r.depth: r.most for r in sizes.groupBy("depth").agg(F.max("count").alias("most")).collect()}
    depth = next((d for d in range(GROUPS) if largest.get(d, 0) <= bucket), GROUPS)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[str], list[int]]] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                some = batch.slice(first, 4096)
                keys, budgets, rows = [], [], []
                for i, counts in enumerate(some.column(2).to_pylist()):
                    own = counts[:depth]
                    if own not in known:
                        later = reached(own)
                        known[own] = [own, *(k for k, _ in later)], [OWN, *(left for _, left in later)]
                    of, left = known[own]
                    keys += of
                    budgets += left
                    rows += [i] * len(of)
                at = pa.array(rows, pa.int32())
                columns = [pa.array(keys, pa.string()), pa.array(budgets, pa.int32()), *(c.take(at) for c in some.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "budget", "word", "n", "counts"])

    routed = words.select("word", "n", "counts").mapInArrow(
        route, "key string, budget int, word string, n long, counts string"
    )
    # buckets that no depth makes small: their words are dealt to blocks, queries go to each
    many = sizes.where((F.col("depth") == depth) & (F.col("count") > bucket)).select(
        "key", F.ceil(F.col("count") / bucket).cast("int").alias("blocks")
    )
    if largest.get(depth, 0) > bucket:
        routed = routed.join(many, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        at = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
        mine = F.col("budget") == OWN
        # a word is also a query in the later blocks of its own bucket
        blocks = F.sequence(F.when(mine, F.col("at")).otherwise(0), F.col("blocks") - 1)
        routed = routed.withColumn("at", at).withColumn("block", F.explode(blocks))
        routed = routed.withColumn("budget", F.when(mine & (F.col("block") > F.col("at")), 3).otherwise(F.col("budget")))
    else:
        routed = routed.withColumn("block", F.lit(0))
    placed = routed.select("key", "block", "budget", "counts", "word", "n")
    placed = placed.repartition("key", "block").sortWithinPartitions("key", "block", "budget", "counts")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[tuple[str, int, str, int]] = []

        def done() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["a", "n_a", "b", "n_b"]
            )
            out.clear()
            return found

        of, held, trie, asked, leaves = None, [], None, None, []
        for row in _rows(batches):
            *bucket_of, budget, counts, word, n = row
            if bucket_of != of:
                if trie is None and held:
                    yield from _own(held, depth, out, done)
                of, held, trie, asked = bucket_of, [], None, None
            if budget == OWN:
                held.append((word, n, counts.encode()))
                continue
            if not held:
                continue
            if trie is None:
                trie = yield from _own(held, depth, out, done)
            if (budget, counts) != asked:  # words with the same counts follow each other
                asked = budget, counts
                leaves = search(trie, counts.encode(), depth, budget >> 1, budget & 1)
            for leaf in leaves:
                out.extend((word, n, w, m) for w, m in leaf.near(word))
            if len(out) > 20000:
                yield done()
        if trie is None and held:
            yield from _own(held, depth, out, done)
        if out:
            yield done()

    return placed.mapInArrow(match, "a string, n_a long, b string, n_b long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _own(held: list[tuple[str, int, bytes]], depth: int, out: list, done) -> Iterator[pa.RecordBatch]:
    """Pairs among a bucket's own words; returns the trie that holds them."""
    trie, asked, leaves = trie_of(held, depth), None, []
    for word, n, counts in held:
        if counts != asked:
            asked, leaves = counts, search(trie, counts, depth, 1, 1)
        for leaf in leaves:
            out.extend((word, n, w, m) for w, m in leaf.near(word) if word < w)
        if len(out) > 20000:
            yield done()
    return trie


def variants(words: DataFrame, *, ratio: int = RATIO, bucket: int = BUCKET) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``(word, n, counts)``.

    Forms grow by ``ratio`` at each step, so chains are short; each round doubles how far
    a word has followed its own, until no word moves.
    """
    words = materialize(words.select("word", "n", "counts"))
    pairs = near_pairs(words, bucket=bucket)
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"n_{b}").alias("m"), F.col(b).alias("near"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    best: Column = F.min(F.struct((-F.col("m")).alias("m"), "near"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    much = -F.col("best.m") >= ratio * F.col("n")
    out = materialize(
        words.join(near, "word", "left").select(
            "word",
            F.when(much, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(much, -F.col("best.m")).alias("form_n"),
        )
    )
    links = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("up"))
        links = materialize(
            links.join(up, "root", "left").select(
                "word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")
            )
        )
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    return out.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """The words of ``docs (doc_id, text)`` with their forms and roots."""
    return variants(word_counts(docs, **options))
