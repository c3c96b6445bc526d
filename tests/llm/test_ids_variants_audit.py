"""Token-id files, spelling variants and the filter audit beside plain Python."""

import itertools
import json
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from gapweave.llm import filter_audit as audit, spelling_variants as spelling, wavelet_ids as ids  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, word string, n long, body string, part string"


def table(spark, rows):
    """Documents ``(doc_id, text, lang)`` with further columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], DOCS)


def awkward(seed, n=40):
    rng = random.Random(seed)
    words = "the of Überfluß naïve don't they'll x1 2024 中文 🙂 <|endoftext|> a.b,c #tag\x1cz ".split(" ")
    blanks = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " \n", "\xa0", " ", "　", "\r\n", "\x85"]
    rows = [(0, None, "en"), (1, "", "en"), (2, " ", None), (None, "no id here", "de"), (None, "no id here", "de")]
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randint(0, 60)))
        rows.append((10 + i, text, rng.choice(["en", "de", None])))
    rows += [(12, rows[7][1], "en"), (12, "another text of the same id", "fr")]
    rows.append((5, "long " * 30000 + "end", "en"))
    rng.shuffle(rows)
    return rows


# token ids


def test_pieces_have_the_ids_of_whole_texts():
    with open(BPE, encoding="utf-8") as f:
        spec = f.read()
    texts = [t or "" for seed in range(4) for _, t, _ in awkward(seed)]
    for special in (True, False):
        encoder, plain = ids.Encoder(spec, special=special), Tokenizer.from_str(spec)
        plain.encode_special_tokens = not special
        assert encoder.by_piece
        for some in (texts, texts[::-1]):
            for text, raw in zip(some, encoder.encode(some)):
                assert np.frombuffer(raw, encoder.type).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_pieces_are_forgotten_in_turn(monkeypatch):
    monkeypatch.setattr(ids, "MOST_PIECES", 5)
    with open(BPE, encoding="utf-8") as f:
        encoder = ids.Encoder(f.read())
    texts = [f"word{i} is, and was word{i // 2}." for i in range(40)]
    want = [encoder._whole([t])[0] for t in texts]
    assert [encoder.encode([t])[0] for t in texts] == want


class Counted:
    """A tokenizer that counts the characters it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.sent = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.sent += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_a_word_is_encoded_once_whatever_marks_and_lines_end_it():
    with open(BPE, encoding="utf-8") as f:
        encoder = ids.Encoder(f.read())
    words = [f"wörd{chr(97 + i % 26)}{chr(97 + i // 26)}ing" for i in range(300)]
    texts = ["So " + " ".join(w + end for w in words) for end in ("", ".", "###", "),", "$$$;", ".\nThen")]
    want = [encoder._whole([t])[0] for t in texts]
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    assert encoder.encode(texts) == want
    assert counted.sent < 2 * sum(map(len, words))
    sent = counted.sent
    assert encoder.encode(texts[::-1]) == want[::-1] and counted.sent == sent
    rows = pa.array(texts[:5], pa.large_string())
    assert encoder._spaced(rows, step=7) == want[:5]


def test_a_word_is_encoded_once_whatever_marks_and_lines_precede_it():
    with open(BPE, encoding="utf-8") as f:
        encoder = ids.Encoder(f.read())
    words = [f"wörd{chr(97 + i % 26)}{chr(97 + i // 26)}ing" for i in range(40)]
    texts = [" ".join(a + mark + b for a in words for b in words) for mark in "-/.\n"]
    want = [encoder._whole([t])[0] for t in texts]
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    assert encoder.encode(texts) == want
    assert counted.sent < 6 * sum(len(w) + 1 for w in words)


def test_known_words_take_no_call_each():
    with open(BPE, encoding="utf-8") as f:
        encoder = ids.Encoder(f.read())
    text = " ".join(f"{a}{b}{c}ing" + "., \n"[len(a + b) % 4] for a, b, c in itertools.product("bdfgklmnprst", repeat=3))
    want, calls = encoder._whole([text]), []
    assert encoder.encode([text]) == want
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        got = encoder.encode([text])
    finally:
        sys.setprofile(None)
    assert got == want and len(calls) < 1000


def test_frequent_words_are_kept(monkeypatch):
    monkeypatch.setattr(ids, "MOST_PIECES", 8)
    with open(BPE, encoding="utf-8") as f:
        encoder = ids.Encoder(f.read())
    encoder.encode([" often" * 50 + " too" * 40 + "".join(f" rare{c}" for c in "abcdefgh")])
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    assert encoder.encode([" often too"]) == encoder._whole([" often too"])
    assert counted.sent == len(" often too") and len(encoder.known) == 4


def test_long_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(ids, "MOST_BYTES", 1000)
    with open(BPE, encoding="utf-8") as f:
        encoder = ids.Encoder(f.read())
    texts = [f"{chr(0x4E00 + i)}" * 100 for i in range(20)]
    want = encoder._whole(texts)
    assert [encoder.encode([t])[0] for t in texts] == want and encoder.known.nbytes < 2000


def test_texts_of_one_kind_alone():
    with open(BPE, encoding="utf-8") as f:
        encoder = ids.Encoder(f.read())
    for texts in ([], [""], ["", " "], ["a  b\t c", "\n  x"], ["a\x1cb", "\x85 y"], [" a", "b ", "\n\nc d\n"], ["it's 'so', he's' \"'s\"."]):
        assert encoder.encode(texts) == encoder._whole(texts)


def test_words_are_not_cut_within_added_tokens():
    with open(BPE, encoding="utf-8") as f:
        made = json.load(f)
    made["added_tokens"] += [{**made["added_tokens"][0], "id": 50257 + i, "content": c} for i, c in enumerate(["U.S.", "x#"])]
    encoder, plain = ids.Encoder(json.dumps(made)), Tokenizer.from_str(json.dumps(made))
    texts = ["in the U.S. and U.S., the U.S.A.", "x# ax# x## x. x, U.S.", "U.S.\nx#\nend."]
    for text, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, encoder.type).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n, top, block", [(0, 5, 64), (1, 1, 64), (700, 9, 64), (5000, 50000, 512), (512, 3, 512)])
def test_file_answers_as_the_list(n, top, block):
    rng = np.random.default_rng(n)
    values = rng.integers(0, top, n).astype(np.uint16)
    width = max(1, top.bit_length())
    cuts = sorted(rng.integers(0, n + 1, 3).tolist())
    lengths = np.diff([0, *cuts, n]).tolist()
    file = ids.from_bytes(ids.pack([7, None, 9, 9], lengths, values, width, block))
    assert file.all_tokens().tolist() == values.tolist() and file.doc_ids == [7, None, 9, 9]
    assert [file.token(i) for i in range(0, n, 37)] == values[::37].tolist()
    for token in {*values[:20].tolist(), 0, top, 1 << 20}:
        at = np.flatnonzero(values == token)
        assert file.count(token) == len(at) and file.places(token).tolist() == at.tolist()
        assert file.count(token, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        assert [file.select(token, k) for k in range(0, len(at), 11)] == at[::11].tolist()
        with pytest.raises(IndexError):
            file.select(token, len(at))
    for k in range(4):
        assert file.document(k) == values[sum(lengths[:k]) : sum(lengths[: k + 1])].tolist()
    with pytest.raises(ValueError):
        ids.from_bytes(b"something else")


def test_files_of_a_corpus(spark):
    rows = awkward(9)
    plain = Tokenizer.from_file(BPE)
    listed = ids.encode_corpus(table(spark, rows), BPE, shard_ids=400)
    got = ids.read_documents(listed, with_ids=True).collect()
    encoded = [(i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == sorted(
        (i is None, i or 0, x) for i, x in encoded
    )
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    order = [(r.doc_id is None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    files = listed.orderBy("start").collect()
    assert len(files) > 5 and sum(f.n_tokens for f in files) == at and all(f.n_docs == 1 or f.n_tokens <= 400 for f in files)
    with_token = ids.opened(files[0].path)
    assert with_token.n == files[0].n_tokens and with_token.count(2) == with_token.all_tokens().tolist().count(2)
    every = Counter(x for _, found in encoded for x in found)
    counted = {r.token: r.n for r in ids.count_tokens(listed, [2, 262, 50256, 60000]).collect()}
    assert counted == {t: every[t] for t in (2, 262, 50256, 60000)}
    found = Counter((r.token, r.doc_id, r.place) for r in ids.find_tokens(listed, [262, 50256]).collect())
    assert found == Counter((x, i, k) for i, e in encoded for k, x in enumerate(e) if x in (262, 50256))


def test_no_documents_no_files(spark):
    listed = ids.encode_corpus(table(spark, []), BPE)
    assert ids.read_documents(listed).collect() == [] and ids.count_tokens(listed, [2]).collect() == []


# spelling variants


def plain_counts(rows, misspell=31, shortest=7, least=2):
    found = Counter()
    for i, text, _ in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % misspell == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def plain_variants(counts, ratio=10):
    near = {w: [v for v in counts if v != w and spelling.one_apart(v, w)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts.get(form.get(w)))
    return out


def test_one_apart():
    letters = "abé"
    words = ["".join(w) for k in range(5) for w in itertools.product(letters, repeat=k)]
    inserted = {w: {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} for w in words}
    replaced = {w: {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} - {w} for w in words}
    for a, b in itertools.combinations(words, 2):
        assert spelling.one_apart(a, b) == spelling.one_apart(b, a) == (b in inserted[a] or a in inserted[b] or b in replaced[a])
    assert not spelling.one_apart("ab", "ab")


def misspelt(seed):
    rng = random.Random(seed)
    stems = ["analysis", "überfluß", "zyzzyvas", "tessellate", "ÀÿÖ×÷éàâ"]
    words = []
    for stem in stems:
        words += [stem] * 1300
        for _ in range(60):
            at, c = rng.randrange(len(stem)), rng.choice("abézx")
            new = rng.choice([stem[:at] + stem[at + 1 :], stem[:at] + c + stem[at:], stem[:at] + c + stem[at + 1 :]])
            words += [new] * rng.choice([1, 2, 2, 11, 130])
    # anagrams of one another: all in one leaf
    words += [w for p in itertools.islice(itertools.permutations("abcdefgh"), 90) for w in ["".join(p)] * rng.choice([2, 3, 25])]
    rng.shuffle(words)
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words[i::97]), "en") for i in range(97)]
    return rows + [(None, "analysis analysis, analysIs", "en"), (3, None, "en"), (4, "", "en"), rows[5], rows[5]]


@pytest.mark.parametrize("bucket", [8192, 40, 5])
def test_variants(spark, bucket):
    rows = misspelt(1)
    counts = plain_counts(rows)
    want = plain_variants(counts)
    got = spelling.variants(spelling.word_counts(table(spark, rows)), bucket=bucket).collect()
    assert {r.word: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert any(f for f, *_ in want.values()) and any(r != f and f for f, r, *_ in want.values())


def test_no_words(spark):
    assert spelling.spelling_variants(table(spark, [(1, "a few short words", "en")])).collect() == []
    assert spelling.spelling_variants(table(spark, [])).collect() == []


# filter audit


def plain_audit(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    marks = {}
    for i, quality, toxic in labels:
        old = marks.get(i, (None, None))
        marks[i] = tuple(max((x for x in p if x is not None), default=None) for p in zip(old, (quality, toxic)))
    docs = []
    for i, text, lang in rows:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", body)) > 3 * len(body),
            "D": bool(re.search("[#$%&*|]", body)),
            "E": i is not None and first[body] < i,
        }
        good, toxic = marks.get(i, (None, None)) if i is not None else (None, None)
        docs.append((lang or "", {k for k, v in failed.items() if v}, good == 1, toxic == 1))
    out, total = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                fails = sum(f in d[0] for d in own)
                alone = sum(d[0] == {f} for d in own)
                out[part, "".join(order), step] = (
                    len(stay), len(gone), fails - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)
                )
                total[part, f] += len(gone)
                left = stay
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(seed):
    rng = random.Random(seed)
    rows = [(None, None, None), (None, "", "en"), (1, None, "en"), (2, "", None), (2, "", "de"), ((1 << 63) - 1, "", "en")]
    bodies = []
    for _ in range(40):
        words = ["".join(rng.choice("abcXY#%") for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([3, 199, 200, 260]))]
        bodies.append(" ".join(words) + rng.choice(["", "\n", "Ünï", "$"]))
    bodies += [" ".join(str(i) for i in range(250)), " ".join(str(i // 2) for i in range(400)), "A" * 3 + "x" * 97]
    for i in range(300):
        rows.append((rng.choice([i, i, 7, None]), bodies[int(len(bodies) * rng.random() ** 3)], rng.choice(["en", "de", "", None])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def test_audit(spark):
    rows, labels = audit_rows(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit_text_filters(table(spark, rows), marks).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert found == plain_audit(rows, labels) and len(found) == len(got) == 600 * len({r.part for r in got})


def test_audit_without_rows(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_text_filters(table(spark, []), marks).collect() == []


def test_audit_of_other_filters(spark):
    """Two conditions and no look at copies."""
    docs = table(spark, [(i, "t", "en") for i in range(12)])
    marks = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    conditions = {"x": F.col("doc_id") % 2 == 0, "y": F.col("doc_id") % 3 == 0}
    counts = audit.failure_counts(docs, marks, conditions, F.lit("all"), copies=False)
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(counts, list(conditions)).collect()}
    assert got == {
        ("xy", 1): (6, 6, 0, 4, 1, 0, 10), ("xy", 2): (4, 2, 2, 2, 0, 0, 6),
        ("yx", 1): (8, 4, 0, 2, 0, 0, 6), ("yx", 2): (4, 4, 2, 4, 1, 0, 10),
    }
    with pytest.raises(ValueError):
        audit.audit(counts, "abcdefghi")
