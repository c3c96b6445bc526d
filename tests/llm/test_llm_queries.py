"""Every corpus query on the smallest tables: beside its SQL, or beside plain Python."""

import base64
import hashlib
import os
import re
import sys
import zlib

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import brute_llm as brute  # noqa: E402
from check_oracle import TABLES, rows_of, same  # noqa: E402
from gapweave.llm.oracle import ORACLE  # noqa: E402
from gapweave.llm.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(db):
    return db.execute("select doc_id, text from documents order by 1").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_beside_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    assert got and sorted(names) == sorted(df.columns) and len(got) == len(want)
    off = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    assert not off, off[:3]


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_string_tiling(spark, db, texts):
    got = {(r.doc_id, r.item_id): r.tiled_words for r in QUERIES["op1_string_tiling"](spark, FOLDER).collect()}
    items = [(i, brute.folded_words(t)) for i, t in db.execute("select item_id, text from benchmark").fetchall()]
    want = {}
    for d, text in texts:
        words = brute.folded_words(text)
        grams = set(zip(*(words[k:] for k in range(5))))
        for i, item in items:
            if grams & set(zip(*(item[k:] for k in range(5)))):
                tiled = brute.greedy_tiles(words, item)
                if tiled >= 0.5 * len(item):
                    want[d, i] = tiled
    assert got == want and got


def test_suffix_array(spark, texts):
    rows = QUERIES["op4_suffix_array"](spark, FOLDER).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == brute.removed(texts) and sum(r.n_removed for r in rows) > 0


def test_arc_to_warc(spark, db):
    pages = db.execute("select page_id, coalesce(html, '') from pages").fetchall()
    largest = {}
    for i, html in pages:
        largest[html] = max(i, largest.get(html, i))
    got = {tuple(r) for r in QUERIES["op6_arc_to_warc"](spark, FOLDER).collect()}
    want = set()
    for i, html in pages:
        body, to = html.encode(), largest[html]
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.add((i, len(body), sha, *(("response", None) if to == i else ("revisit", to))))
    assert got == want


def test_near_duplicates(spark, texts):
    got = dict(tuple(r) for r in QUERIES["op7_weighted_minhash"](spark, FOLDER).collect())
    want, close = brute.classes(texts, 0.8, margin=0.01)
    unsure = {i for pair in close for i in pair}
    assert {i: c for i, c in got.items() if i not in unsure} == {i: c for i, c in want.items() if i not in unsure}
    assert len(set(got.values())) < len(got)


def test_quality_on_held_out_labels(spark):
    folder = FOLDER.replace("0.001", "0.1")
    if not os.path.isdir(folder):
        pytest.skip("larger tables not present")
    rows = QUERIES["op10_zstd_quality"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = rows.join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    good = [r.predicted for r in found if r.quality == 1]
    bad = [r.predicted for r in found if r.quality == 0]
    assert sum(good) > 0.99 * len(good) and sum(bad) < 0.2 * len(bad)
