"""Nulls, empty and long texts, ties and repeats, empty tables, clashing columns."""

import os
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute_llm as brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from gapweave.llm import arc_warc, decontaminate, license_scan, line_dedup, minhash_icws, mixing  # noqa: E402
from gapweave.llm import preferences, quality_rules, suffix_dedup, zstd_quality  # noqa: E402
from gapweave.llm.components import components  # noqa: E402

PROSE = " ".join(f"word{i * 7919 % 1000}" for i in range(200))
LONG = " ".join(f"w{i * 31 % 9973}" for i in range(30000))
DOCS = [
    (1, PROSE, "en", "a", 10),
    (2, PROSE + " and more", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (5, " \t\n ", "en", "b", 5),
    (6, LONG, "de", "b", 7),
    (7, LONG, "de", None, 7),
    (7, LONG, "de", None, 7),
    (8, "one line\n" * 40 + PROSE, "fr", "a", 1),
    (None, "no id here, but a text", "en", "a", 3),
    (9, "Ünïcödé 漢字 🎉 " * 30, "xx", "c", 2),
    (10, "Released under the MIT License.", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("size", "score", "id", "root", "_host", "line", "failed", "copies", "n_words", "predicted", "prompt", "rank", "_lines", "_rank", "_key", "_norm", "_w", "_l")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def odd(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=str)


def test_mix(odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == len(DOCS) and all(r.taken == r["size"] * r.copies for r in rows)
    sizes, targets, taken = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
        assert len(r.positions or []) == r.copies <= 3 and all(0 <= p <= 1 for p in r.positions or [])
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for s, n in sizes.items():
        biggest = max((r["size"] for r in rows if r.source == s), default=0)
        assert targets[s] <= 3 * n + 1e-9 and abs(taken[s] - targets[s]) <= biggest / 2 + 1
    assert mixing.mix_sources(none).count() == 0


def test_inverted_schedule():
    # half of the weight of a schedule falling from 2 to 0 is given out at 1 - sqrt(1/2)
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    at = mixing.invert(F.col("u"), ((0.0, 2.0), (1.0, 0.0)))
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "u double").select(at).collect()]
    assert got == pytest.approx([0.0, 1 - 0.5**0.5, 1.0])


def test_licenses(odd, none, spark):
    found = [(r.doc_id, r.license, r.dice) for r in license_scan.scan_licenses(odd).collect()]
    assert found == [(10, "MIT", 1.0)]
    assert license_scan.scan_licenses(none).count() == 0
    text = "First words.\nlicensed  under the APACHE license (version 2.0)\nReleased under a licence."
    near = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.line, r.license) for r in license_scan.scan_licenses(near).collect()] == [(2, "Apache-2.0")]


def test_suffix_array(docs, none, spark):
    rows = suffix_dedup.removed_spans(docs.where("doc_id is not null"), bucket_bytes=2000).collect()
    want = brute.removed([(r[0], r[1]) for r in DOCS if r[0] is not None])
    for r in rows:
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) == want[r.doc_id]
    assert len(rows) == len(DOCS) - 1 and suffix_dedup.removed_spans(none).count() == 0
    last = spark.createDataFrame([(None, PROSE), (3, PROSE), (None, PROSE)], "doc_id long, text string")
    gone = sorted((r.doc_id or 0, sum(s.end - s.start for s in r.spans)) for r in suffix_dedup.removed_spans(last).collect())
    assert gone == [(0, len(PROSE)), (0, len(PROSE)), (3, 0)]


def test_suffix_array_splits_frequent_tokens(spark, monkeypatch):
    import random

    rng = random.Random(3)
    stem = "a very common line that stands in every text of this test"
    texts = [
        (i, " ".join([*(rng.choice("abc") for _ in range(rng.randint(0, 30))), stem, *(rng.choice("abc") for _ in range(40))]))
        for i in range(60)
    ]
    hot = suffix_dedup.Splitters.__init__

    def all_hot(self, one, two, buckets):
        hot(self, one, two, buckets)
        self.hot = {(int(a), int(b)) for a, b in list(zip(one, two))[::2]}
        self.hot_one = suffix_dedup.np.unique(one[::2])

    want = brute.removed(texts)
    for patched in (False, True):
        if patched:
            monkeypatch.setattr(suffix_dedup.Splitters, "__init__", all_hot)
        frame = spark.createDataFrame(texts, "doc_id long, text string")
        for r in suffix_dedup.removed_spans(frame, bucket_bytes=1000).collect():
            assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) == want[r.doc_id]


def test_rules(odd, none):
    book = quality_rules.ledger(odd)
    got = {r[0]: r[1:] for r in by_id(book, "n_words", "n_dup_lines", "n_repeat_words")}
    assert got[1] == (200, 0, 0) and got[3] == got[4] == got[5] == (0, 0, 0)
    assert got[8] == (280, 39, 80)
    table = {r.rule: r for r in quality_rules.ablation(book, "v3").collect()}
    failed = [r.failed for r in book.collect()]
    for name, bit in quality_rules.BITS.items():
        assert table[name].n_failed == sum(1 for f in failed if f & bit)
        assert table[name].n_failed_alone == sum(1 for f in failed if f == bit)
        assert table[name].n_kept_without == sum(1 for f in failed if f in (0, bit))
    assert quality_rules.ledger(none).count() == 0


def test_arc_and_warc(spark):
    pages = [(1, "http://a/x y", "<p>é</p>\n\nWARC/1.1\r\n\r\n", "x"), (2, None, None, "x"), (3, "http://b", "", "x"),
             (4, "http://c", "<p>é</p>\n\nWARC/1.1\r\n\r\n", "x"), (4, "http://c", "<p>é</p>\n\nWARC/1.1\r\n\r\n", "x"),
             (None, "http://d", "only", "x"), (5, "http://e", "z" * 300_000, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_type string")
    rows = arc_warc.convert_pages(df, file_bytes=1000).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in rows if r.page_id != 4)
    size = len(pages[0][2].encode())
    assert got == [(0, 4, "response", None), (1, size, "revisit", 4), (2, 0, "revisit", 3), (3, 0, "response", None), (5, 300_000, "response", None)]
    assert sorted(r.record_type for r in rows if r.page_id == 4) == ["response", "revisit"]
    assert {r.url for r in rows if r.page_id == 1} == {"http://a/x%20y"} and len({r.record_id for r in rows}) == len(pages)
    assert arc_warc.convert_pages(df.limit(0)).count() == 0


def test_arc_lines_by_version():
    for version in (1, 2):
        head = arc_warc.arc_head(version, "f.arc").encode() + b"\n"
        body = b"HTTP/1.1 200 OK\r\n\r\nhttp://no.record 1 2 3 4\n"
        raw = head + arc_warc.arc_record(version, "f.arc", len(head), "http://a b/c", "20010203040506", body) + b"\n\n"
        (r,) = arc_warc.read_arc(raw)
        assert (r.url, r.date, r.mime, r.archive, r.offset, r.body) == ("http://a b/c", "20010203040506", "text/html", "f.arc", len(head), body)
        with pytest.raises(ValueError, match="cut short"):
            list(arc_warc.read_arc(raw[:-10]))
    with pytest.raises(ValueError, match="version"):
        list(arc_warc.read_arc(b"filedesc://x 0 20000101000000 text/plain 6\n3 0 x\n"))


def test_near_duplicates(docs, none, spark):
    got = by_id(minhash_icws.near_duplicates(docs), "class_id")
    want, _ = brute.classes([(r[0], r[1]) for r in DOCS if r[0] is not None], 0.8)
    assert got == sorted([*((i, want[i]) for i, *_ in DOCS if i is not None), (None, None)], key=str)
    assert minhash_icws.near_duplicates(none).count() == 0


def test_near_duplicates_in_chains(spark):
    """Each text is like the next one only, so the class hangs on links between other members than the first."""
    words = [f"t{i}" for i in range(400)]
    texts = [(10 - k, " ".join(words[k * 20 : k * 20 + 250])) for k in range(6)]
    texts += [(100 + k, " ".join(f"u{k}x{i}" for i in range(60))) for k in range(10)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    want, _ = brute.classes(texts, 0.8)
    assert dict(by_id(minhash_icws.near_duplicates(frame), "class_id")) == want


def test_sampling_follows_weighted_jaccard():
    np = minhash_icws.np
    sampler = minhash_icws.Sampler(4000)
    rng = np.random.default_rng(1)
    shingle = minhash_icws.mix64(np.arange(60).astype(np.uint64))
    a, b = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    a[:10], b[50:] = 1e-9, 1e-9
    draws = sampler.draw(np.repeat([0, 1], 60), np.concatenate([shingle, shingle]), np.concatenate([a, b]))
    assert (draws[0] == draws[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 6: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_preferences(spark):
    turns = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "q2"), (0, 3, "assistant", "a2"), (0, 4, "user", "bye"),
        (1, 0, "user", None), (1, 1, "assistant", "other <|im_end|>"), (4, 0, "assistant", "alone"),
        (6, 0, "user", "no reply"), (None, 0, "user", "lost"), (7, 0, None, ""),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in preferences.format_preferences(preferences.reply_pairs(frame)).collect()}
    assert sorted(got) == [0, 1, 4, 6, 7]
    r = got[0]
    assert r.n_prefix == 3 and r.prompt.count("<|im_start|>") == 3
    assert r.rejected == "<|im_start|>assistant\nother < |im_end|><|im_end|>\n"
    ((start, end),) = r.chosen_spans
    assert r.chosen[start:end] == "a2<|im_end|>"
    assert got[4].n_prefix == 0 and got[4].rejected == "" and got[6].chosen == ""
    same = spark.createDataFrame([(1, [("user", "x")], [("user", "x")], "z"), (2, None, [("user", "x")], "z")],
                                 "i int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string")
    got = {r.i: r for r in preferences.format_preferences(same).collect()}
    assert (got[1].n_prefix, got[1].chosen, got[1].rejected) == (1, "", "") and got[2].n_prefix == 0 and got[2].rejected


def test_lines(spark, odd, none):
    assert [r.text for r in line_dedup.drop_boilerplate(odd, min_pages=99).orderBy("n_chars").collect()].count(None) == 1
    assert line_dedup.drop_boilerplate(none).count() == 0
    pages = [(i, f"menu \nown {i}\nmenu\n\n", "h", 3) for i in range(20)] + [(30, "menu", "h", 1), (31, None, "h", 1), (32, "menu\nx", None, 1)]
    frame = spark.createDataFrame(pages, "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(frame).collect()}
    assert got[3] == ("own 3\n\n", 5, 2) and got[30] == ("menu", 1, 0) and got[31] == (None, 0, 0) and got[32] == ("menu\nx", 2, 0)


def test_quality(spark, odd, none):
    good = [(i, " ".join(f"word{(i * 13 + k) % 97}" for k in range(80))) for i in range(60)]
    bad = [(100 + i, " | ".join(f"x{(i + k) % 5}%%" for k in range(40))) for i in range(60)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = zstd_quality.fit_quality(frame, labels)
    got = {r.doc_id: r.predicted for r in zstd_quality.score_quality(frame, model).collect()}
    assert all(got[i] == int(i < 100) for i in got)
    rows = zstd_quality.score_quality(odd, model).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if not r.text} == {0.0}
    assert zstd_quality.score_quality(none, model).count() == 0
    assert zstd_quality.fit_quality(frame, labels.where("quality = 1")) is None
    assert {r.score for r in zstd_quality.score_quality(odd, None).collect()} == {0.5}


def test_decontamination(spark, odd, none):
    item = [f"b{i}" for i in range(40)]
    moved = " ".join(item[20:] + ["and"] + item[:20])
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "too short"), (3, None), (None, " ".join(item[::-1]))], "item_id long, text string")
    texts = spark.createDataFrame([(1, PROSE + " " + moved), (2, " ".join(item[:12])), (3, None), (4, LONG + " " + " ".join(item).upper() + "!")], "doc_id long, text string")
    for block in (200_000, 30):
        got = sorted((r.doc_id, r.item_id, r.tiled_words, r.n_tiles) for r in decontaminate.contaminated(texts, bench, block_words=block).collect())
        assert got == [(1, 1, 40, 2), (4, 1, 40, 1)]
        assert sorted(r.doc_id for r in decontaminate.drop_contaminated(texts, bench, block_words=block).collect()) == [2, 3]
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.drop_contaminated(odd, bench.limit(0)).count() == len(DOCS)
    assert decontaminate.contaminated(none, bench).count() == 0


def test_tiles_take_the_longest_first():
    np = decontaminate.np
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(1, 4, rng.integers(5, 60)), rng.integers(1, 4, rng.integers(5, 30))
        got = decontaminate.tiles(a.astype(np.uint64), b.astype(np.uint64), 5)
        assert [n for *_, n in got] == sorted((n for *_, n in got), reverse=True)
        for side, arr in ((0, a), (1, b)):
            used = np.zeros(len(arr), int)
            for t in got:
                used[t[side] : t[side] + t[2]] += 1
            assert used.max(initial=0) <= 1
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in got)
        longest = max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(60) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]), 0)]), default=0)
        assert (got[0][2] if got else 0) == (longest if longest >= 5 else 0)


def test_pipeline_stages_take_odd_documents(spark, odd, none, tmp_path):
    bench = spark.createDataFrame([(1, PROSE[:300])], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (odd, none):
        frame.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            assert out.count() <= frame.count()
        rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
        ids = [r.doc_id for r in rows]
        if frame is odd:
            # 1, 2 and 8 hold the item; 7 is a copy of 6; 3 to 5 have no words to take
            assert set(ids) <= {6, 9, 10, None} and ids.count(6) <= 1
        else:
            assert rows == []


def test_pipeline_beside_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables not present")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want, close = brute.classes(texts, 0.8, margin=0.01)
    unsure = {i for pair in close for i in pair}
    kept = {r.doc_id for r in stage["near_copies"](spark, docs, folder).collect()}
    assert {i for i, c in want.items() if i == c} - unsure == kept - unsure
    items = [brute.folded_words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stage["decontaminate"](spark, docs, folder).collect()}
    for i, text in texts:
        words = brute.folded_words(text)
        grams = set(zip(*(words[k:] for k in range(5))))
        dirty = any(
            grams & set(zip(*(item[k:] for k in range(5)))) and brute.greedy_tiles(words, item) >= 0.5 * len(item) for item in items
        )
        assert (i in clean) != dirty
    final = corpus_pipeline.run(spark, folder).collect()
    assert final and len({r.doc_id for r in final}) == len(final)
    firsts = [r.positions[0] for r in final]
    assert firsts == sorted(firsts) and all(r.copies >= 1 for r in final)


def test_two_texts_under_one_id(spark):
    """Each text has its own class, and a class its smallest id; no row is lost or chosen at will."""
    other = " ".join(f"other{i}" for i in range(150))
    near = other.replace("other3 ", "another ")
    rows = [(1, PROSE), (5, PROSE + " more"), (5, other), (3, near), (5, other), (8, "only here " * 9), (8, "only there " * 9)]
    frame = spark.createDataFrame([(i, t, "x", "y", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    want = [(1, 1), (3, 3), (5, 1), (5, 3), (5, 3), (8, 8), (8, 8)]
    assert by_id(minhash_icws.near_duplicates(frame), "class_id") == want
    kept = by_id(minhash_icws.first_of_classes(frame), "text", "n_chars")
    assert kept == by_id(minhash_icws.first_of_classes(frame.repartition(5)), "text", "n_chars")
    assert sorted((i, t) for i, t, _ in kept) == sorted([(1, PROSE), (3, near), (8, "only here " * 9), (8, "only there " * 9)])


def test_first_of_classes_keeps_other_columns_and_repeats_once(docs, none):
    odd = docs.withColumns({"_id": F.lit("x"), "_mark": F.lit("y")})
    kept = minhash_icws.first_of_classes(odd)
    assert kept.columns == odd.columns
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [None, 1, 3, 6, 8, 9, 10]
    assert minhash_icws.first_of_classes(none).count() == 0


def test_repeated_bytes_of_rows_without_id(spark):
    """Rows without id are told apart, and the largest id stays what it is."""
    last = (1 << 63) - 1
    unique = [" ".join(f"u{i}x{j}" for j in range(25)) for i in range(3000)]
    shared = "a passage that is more than fifty bytes long, shared by some of them; "
    texts = [shared + t if i % 3 == 0 else t for i, t in enumerate(unique)]
    rows = [(4, shared + "first"), (last, "kept apart " + unique[0])] + [(None, t) for t in texts] + [(None, texts[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = suffix_dedup.removed_spans(frame, bucket_bytes=4096).collect()
    assert len(got) == len(rows) and sum(r.doc_id == last for r in got) == 1
    cut = [r for r in got if r.spans]
    assert len(cut) == 1001 and all(r.doc_id is None for r in cut)
    assert all(sum(s.end - s.start for s in r.spans) >= len(shared.encode()) for r in cut)


def test_tiles_of_repetitive_texts():
    """The same tiles as by listing all pairs, and no slower for it."""
    rng = np.random.default_rng(5)
    for k in range(150):
        top = 1 + k % 4
        a, b = (rng.integers(1, top + 1, n).astype(np.uint64) for n in rng.integers(0, 60, 2))
        got = decontaminate.tiles(a, b, 5)
        assert sum(n for _, _, n in got) == brute.greedy_tiles(a.tolist(), b.tolist())
    started = time.time()
    assert decontaminate.tiles(np.ones(20000, np.uint64), np.ones(2000, np.uint64), 5) == [(0, 0, 2000)]
    assert time.time() - started < 10


def test_repetitive_document_against_repetitive_item(spark):
    docs = spark.createDataFrame([(1, "again " * 20000), (2, "again and " * 9000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "again " * 2000), (8, "and again " * 300)], "item_id long, text string")
    started = time.time()
    got = {(r.doc_id, r.item_id): r.tiled_words for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 7): 2000, (2, 8): 600} and time.time() - started < 150
