"""Token ids of a corpus in wavelet matrices: one compressed file a shard.

A wavelet matrix keeps a sequence of ids as bit planes, the highest bit first; each plane is
ordered by the bits above it, zeros before ones. With counts of ones along each plane
(rank) and their inverse (select), one file answers what the id at a place is, how often an
id occurs in a stretch, and where it occurs, without unpacking the rest.

File format, little-endian: the magic ``GWWM0001``; an unsigned 64-bit length and as many
bytes of JSON (``n`` ids, ``docs``, ``width`` planes, ``block`` bits, ``zeros`` of each
plane, ``parts``: name to (offset, length) from the end of the JSON); then the parts, each a
zstandard frame: ``ids`` and ``known`` (document ids, 64-bit, and whether they are known),
``lengths`` (ids of each document, 64-bit), ``ones`` (ones before each block of each plane,
64-bit), ``places`` (end of each block's frame within ``bits``, 64-bit); and ``bits``, where
each block of each plane is a frame of its own, so a lookup unpacks one block a plane.

Defined results: null texts are empty, and an empty document is its end id alone. Documents
are in ascending ``doc_id``, unknown ids last; rows that share an id are ordered by a hash of
the text. A text is never split: a shard holds whole documents, ``shard_ids`` ids or one
document. A table without rows gives no shard. Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from gapweave.storage import materialize, work_folder

MAGIC = b"GWWM0001"
END_ID = 2
SHARD_IDS = 1 << 21
BLOCK = 1 << 16
MOST_PIECES = 3 << 17
MOST_BYTES = 64 << 20  # of known pieces: texts without blanks are pieces of any length
ENCODE_CHARS = 8 << 20
READ_SHARDS = 4  # shards a reading task
COPY_BYTES = 4 << 20

# Characters that Arrow and the tokenizers library may take differently for white
# space; texts with one are encoded whole. Borders are sought among bytes, so blanks beyond
# ASCII are told apart: a text with one before an ASCII blank is cut by ``PIECE`` instead.
UNSURE = "[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]"
WIDE = "\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = f"[\t-\r {WIDE}]"
LOOSE = f"[{WIDE}][\t-\r ]"
PIECE = re.compile(r"\s*\S+|\s+")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe: it may go with letters after it
LETTERS = frozenset(chr(c) for r in ((65, 91), (97, 123), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x100)) for c in range(*r))
LATIN = 0xC3  # the first byte of U+00C0 to U+00FF, none of which is white space
BLANK, FIRST, LETTER, TAIL, MARK = 1, 2, 4, 8, 16  # what a byte may be; ``TAIL``: a letter after ``LATIN``


def byte_kinds(marks: str) -> bytes:
    """What each of the 256 bytes of UTF-8 may be."""
    b = np.arange(256)
    return sum(
        np.uint8(bit) * which
        for bit, which in (
            (BLANK, np.isin(b, list(b"\t\n\v\f\r "))),
            (FIRST, (b > 0x20) & (b < 0x7F) | (b == LATIN)),  # a visible character begins here
            (LETTER, np.isin(b, [ord(c) for c in LETTERS if c < "\x80"])),
            (TAIL, (b >= 0x80) & (b < 0xC0) & (b != 0x97) & (b != 0xB7)),
            (MARK, np.isin(b, [ord(m) for m in marks])),
        )
    ).tobytes()


class Encoder:
    """Ids of whole texts by a tokenizer of the ``tokenizers`` library, given as its JSON.

    A byte-level tokenizer never joins across the border between a visible character and
    white space, between a letter and one of ``MARKS`` that no added token holds, and after a
    single line end between visible characters. What lies between two borders always has the
    same ids, so each distinct piece is encoded once and kept, about ``MOST_PIECES`` of the most
    frequent. Pieces are cut, numbered and looked up for many texts at once, by NumPy and Arrow;
    their ids are then laid out by number.
    Tokenizers of another make get whole texts.
    ``special`` tells whether the texts of special tokens mean those tokens, as is the
    library's default, or are ordinary text.
    """

    def __init__(self, spec: str, *, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = not special
        made = json.loads(spec)
        before = made.get("pre_tokenizer") or {}
        added = {t["content"]: t for t in made.get("added_tokens") or []}
        self.by_piece = (
            not made.get("normalizer")
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", c) for c, t in added.items())
            and not any(set(c) <= LETTERS for c in added)
        )
        alone = any(t.get("single_word") for t in added.values())  # these tell "_" from other marks
        marks = (m for m in MARKS if not any(m in c for c in added) and not (alone and m == "_"))
        self.kinds = byte_kinds("".join(marks))
        vocabulary = self.tokenizer.get_vocab(True)
        self.width = max(1, max(vocabulary.values(), default=0).bit_length())
        self.type = np.dtype("<u2" if self.width <= 16 else "<u4")
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level token has one letter for each byte
            self.bytes_of[i] = len(token.encode()) if token in added else len(token)
        end = self.tokenizer.encode_batch_fast(["\n"], add_special_tokens=False)[0].ids
        self.by_piece = self.by_piece and [int(self.bytes_of[i]) for i in end] == [1]
        self.known = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())
        self.uses = np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.type).tobytes() for e in found]

    def _joined(self, pieces: pa.Array, before: str = "", step: int = 500) -> pa.Array:
        """Ids of pieces that end visibly, as one text cut by bytes.

        They begin with white space or, if visibly, get a line end ``before`` them, whose id is dropped.
        """
        found, sizes = [np.zeros(0, self.type)], [np.zeros(1, np.int64)]
        for i in range(0, len(pieces), step):
            some = pieces[i : i + step]
            text = before + before.join(some.to_numpy(False))
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            ends = np.cumsum(self.bytes_of[ids])
            want = np.cumsum(pc.binary_length(some).to_numpy() + len(before))
            cut = np.searchsorted(ends, want)
            if cut[-1] >= len(ends) or not (ends[cut] == want).all():
                raise AssertionError("the tokenizer joins across blanks")
            size, first = np.diff(cut, prepend=-1), np.concatenate(([0], cut[:-1] + 1))
            found.append((np.delete(ids, first) if before else ids).astype(self.type))
            sizes.append(size - len(before))
        ends = np.cumsum(np.concatenate(sizes)) * self.type.itemsize
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(found))]
        )

    def _learned(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces by the library."""
        begins = pc.match_substring_regex(pieces, f"^{BLANKS}").to_numpy(False)
        ends = pc.match_substring_regex(pieces, f"{BLANKS}$").to_numpy(False)
        kinds = [np.flatnonzero(k) for k in (begins & ~ends, ~begins & ~ends, ends)]
        spaced, visible, others = (pieces.take(pa.array(k)) for k in kinds)
        found = (
            self._joined(spaced),
            self._joined(visible, "\n"),
            pa.array(self._whole(others.to_pylist()), pa.large_binary()),
        )
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.concatenate(kinds))))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of pieces among those known; new ones are learned."""
        if len(self.known) > MOST_PIECES or self.known.nbytes > MOST_BYTES:
            keep = np.argsort(-self.uses, kind="stable")[: MOST_PIECES // 2]
            size = np.cumsum(pc.binary_length(self.known).to_numpy()[keep])
            keep = np.sort(keep[size <= MOST_BYTES // 2])
            self.known, self.ids = self.known.take(pa.array(keep)), self.ids.take(pa.array(keep))
            self.uses = self.uses[keep] >> 1
        coded = pa.chunked_array([self.known, pieces]).dictionary_encode().chunks[-1]
        numbers, old = coded.indices.to_numpy(), len(self.known)
        if len(coded.dictionary) > old:
            self.known = coded.dictionary
            self.ids = pa.concat_arrays([self.ids, self._learned(self.known[old:])])
        uses = np.bincount(numbers, minlength=len(self.known))
        uses[:old] += self.uses
        self.uses = uses
        return numbers

    def _laid_out(self, pieces: pa.Array, cuts: np.ndarray, step: int = 1 << 20) -> list[bytes]:
        """Ids of texts that begin and end at ``cuts`` among their pieces."""
        if not len(pieces):
            return [b""] * (len(cuts) - 1)
        numbers, out = self._numbers(pieces), []
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(self.ids).to_numpy()[numbers])))
        for i in range(0, len(numbers), step):
            some = self.ids.take(pa.array(numbers[i : i + step]))
            out.append(memoryview(some.buffers()[2] or b"")[: ends[i + len(some)] - ends[i]])
        ids, cuts = b"".join(out), ends[cuts].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _spaced(self, texts: pa.Array, step: int = 1 << 20) -> list[bytes]:
        """Ids of texts without blanks of ``LOOSE``, cut at the borders among their bytes."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return [b""] * len(texts)
        data = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0])
        raw, offsets = np.frombuffer(data, np.uint8), offsets - offsets[0]
        kinds = np.frombuffer(data.to_pybytes().translate(self.kinds), np.uint8)
        blank, first, letter, tail, mark = (kinds & bit != 0 for bit in (BLANK, FIRST, LETTER, TAIL, MARK))
        letter[1:] |= tail[1:] & (raw[:-1] == LATIN)
        border = np.zeros(len(raw) + 1, bool)
        border[1:-1] = blank[1:] & ~blank[:-1] | letter[:-1] & mark[1:]
        border[2:-1] |= (raw[1:-1] == 10) & ~blank[:-2] & first[2:]
        border[offsets] = True
        begins = np.flatnonzero(border)
        pieces = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), data)
        return self._laid_out(pieces, np.searchsorted(begins, offsets), step)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian numbers of ``self.type``."""
        if not self.by_piece:
            return self._whole(texts)
        out: list = [None] * len(texts)
        rows = pa.array(texts, pa.large_string())
        unsure = pc.match_substring_regex(rows, UNSURE).to_numpy(False)
        loose = ~unsure & pc.match_substring_regex(rows, LOOSE).to_numpy(False)
        whole, cut, spaced = (np.flatnonzero(k).tolist() for k in (unsure, loose, ~unsure & ~loose))
        pieces = [PIECE.findall(texts[i]) for i in cut]
        cuts = np.cumsum([0, *map(len, pieces)])
        pieces = pa.array(itertools.chain.from_iterable(pieces), pa.large_string())
        for some, found in (
            (whole, self._whole([texts[i] for i in whole])),
            (cut, self._laid_out(pieces, cuts)),
            (spaced, self._spaced(rows.take(pa.array(spaced, pa.int64())))),
        ):
            for i, raw in zip(some, found):
                out[i] = raw
        return out


def encoder_of(spec: str, special: bool) -> Encoder:
    """The process's encoder of a tokenizer: tasks of one worker go on with the pieces of the last.

    Task code is loaded anew for each task, so the encoder is held by a module of its own.
    """
    held = sys.modules.setdefault("_gapweave_encoders", types.ModuleType("_gapweave_encoders")).__dict__
    name = f"{hashlib.sha256(spec.encode()).hexdigest()}_{special}"
    if name not in held:
        held[name] = Encoder(spec, special=special)
    return held[name]


def _halves(high: np.ndarray, low: int, step: int = 1 << 15) -> Iterator[tuple[slice, np.ndarray, np.ndarray, int, int]]:
    """Zeros and ones of a plane, by places within stretches, and where the ``low`` zeros and the ones go.

    Places are taken much faster than by a mask, and a stretch's stay in the processor's cache.
    """
    a, b = 0, low
    for i in range(0, len(high), step):
        some = slice(i, i + step)
        down, up = np.flatnonzero(~high[some]), np.flatnonzero(high[some])
        yield some, down, up, a, b
        a, b = a + len(down), b + len(up)


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int, block: int = BLOCK) -> bytes:
    """The bytes of one file."""
    n = len(ids)
    packer = zstandard.ZstdCompressor(level=1)
    blocks = -(-n // block)
    zeros, ones, frames = [], np.zeros((width, blocks), np.int64), []
    for plane in range(width):
        high = (ids & ids.dtype.type(1 << (width - 1 - plane))).astype(bool)
        packed = np.packbits(high, bitorder="little")
        if blocks:
            counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), block // 8), dtype=np.int64)
            ones[plane, 1:] = np.cumsum(counts)[:-1]
        packed = packed.tobytes()
        frames += [packer.compress(packed[i : i + block // 8]) for i in range(0, len(packed), block // 8)]
        low, ids, from_ = n - int(np.count_nonzero(high)), np.empty_like(ids), ids
        zeros.append(low)
        for some, down, up, a, b in _halves(high, low):
            ids[a : a + len(down)], ids[b : b + len(up)] = from_[some].take(down), from_[some].take(up)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = {
        "ids": np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        "known": known.tobytes(),
        "lengths": np.array(lengths, "<i8").tobytes(),
        "ones": ones.astype("<i8").tobytes(),
        "places": np.cumsum([len(f) for f in frames], dtype="<i8").tobytes(),
    }
    body, at, places = [], 0, {}
    for name, raw in parts.items():
        frame = packer.compress(raw)
        places[name] = (at, len(frame))
        body.append(frame)
        at += len(frame)
    places["bits"] = (at, sum(map(len, frames)))
    head = {"n": n, "docs": len(doc_ids), "width": width, "block": block, "zeros": zeros, "parts": places}
    head = json.dumps(head).encode()
    return b"".join((MAGIC, struct.pack("<Q", len(head)), head, *body, *frames))


class WaveletFile:
    """One file, read through ``source``: anything with ``seek`` and ``read``.

    Only the header and the documents' lengths are read at first; lookups read the blocks
    that they touch, and ``blocks`` of them are kept.
    """

    def __init__(self, source, blocks: int = 256):
        self.source, self.most = source, blocks
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token ids")
        (size,) = struct.unpack("<Q", source.read(8))
        head = json.loads(source.read(size))
        self.n, self.width, self.block, self.zeros = head["n"], head["width"], head["block"], head["zeros"]
        self.parts, self.base = head["parts"], len(MAGIC) + 8 + size
        self.blocks = -(-self.n // self.block)
        self.unpacker, self.cache = zstandard.ZstdDecompressor(), {}
        known = self._part("known", np.uint8)
        self.doc_ids = [int(d) if k else None for d, k in zip(self._part("ids", "<i8"), known)]
        self.starts = np.concatenate(([0], np.cumsum(self._part("lengths", "<i8"))))
        self.ones = self._part("ones", "<i8").reshape(self.width, self.blocks)
        self.ends = np.concatenate(([0], self._part("places", "<i8")))

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(self.base + at)
        return self.source.read(size)

    def _part(self, name: str, kind) -> np.ndarray:
        at, size = self.parts[name]
        return np.frombuffer(self.unpacker.decompress(self._read(at, size)), kind)

    def _bits(self, plane: int, block: int) -> np.ndarray:
        """Bits of a block and, before each, the ones within the block."""
        key = plane * self.blocks + block
        if key not in self.cache:
            if len(self.cache) >= self.most:
                self.cache.pop(next(iter(self.cache)))
            at, end = int(self.ends[key]), int(self.ends[key + 1])
            raw = self.unpacker.decompress(self._read(self.parts["bits"][0] + at, end - at))
            size = min(self.block, self.n - block * self.block)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=size, bitorder="little")
            self.cache[key] = bits, np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
        return self.cache[key]

    def _rank(self, plane: int, at: int) -> int:
        """Ones before place ``at`` of a plane."""
        if at >= self.n:
            return self.n - self.zeros[plane]
        block, rest = divmod(at, self.block)
        return int(self.ones[plane, block]) + int(self._bits(plane, block)[1][rest])

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) one or zero of a plane."""
        before = self.ones[plane]
        if not bit:
            before = np.arange(self.blocks) * self.block - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = self._bits(plane, block)[0]
        return block * self.block + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def token(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.width):
            block, rest = divmod(at, self.block)
            bit, one = int(self._bits(plane, block)[0][rest]), self._rank(plane, at)
            at = self.zeros[plane] + one if bit else at - one
            value = value << 1 | bit
        return value

    def _stretch(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the ids equal to ``token`` within ``start`` to ``end`` lie after the last plane."""
        if token >> self.width:
            return 0, 0
        for plane in range(self.width):
            a, b = self._rank(plane, start), self._rank(plane, end)
            if token >> (self.width - 1 - plane) & 1:
                start, end = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs from ``start`` to before ``end``."""
        a, b = self._stretch(token, start, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of an id."""
        a, b = self._stretch(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for plane in reversed(range(self.width)):
            bit = token >> (self.width - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def places(self, token: int) -> np.ndarray:
        """Places of all occurrences of an id, ascending."""
        a, b = self._stretch(token, 0, self.n)
        at = np.arange(a, b)
        for plane in reversed(range(self.width)):
            bit = token >> (self.width - 1 - plane) & 1
            if not len(at):
                break
            at = at - self.zeros[plane] if bit else at
            before = self.ones[plane] if bit else np.arange(self.blocks) * self.block - self.ones[plane]
            of = np.searchsorted(before, at, "right") - 1
            for block in np.unique(of):
                here = of == block
                at[here] = block * self.block + np.flatnonzero(self._bits(plane, block)[0] == bit)[at[here] - before[block]]
        return at

    def document(self, k: int) -> list[int]:
        """Ids of the ``k``-th document, place by place."""
        return [self.token(i) for i in range(int(self.starts[k]), int(self.starts[k + 1]))]

    def all_tokens(self) -> np.ndarray:
        """All ids, from the last plane back to the first."""
        at, size = self.parts["bits"]
        raw, ends = self._read(at, size), self.ends
        kind = np.uint16 if self.width <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for plane in reversed(range(self.width)):
            keys = range(plane * self.blocks, (plane + 1) * self.blocks)
            bits = b"".join(self.unpacker.decompress(raw[ends[i] : ends[i + 1]]) for i in keys)
            high = np.unpackbits(np.frombuffer(bits, np.uint8), count=self.n, bitorder="little").view(bool)
            value, from_, bit = np.empty(self.n, kind), value, kind(1 << (self.width - 1 - plane))
            for some, down, up, a, b in _halves(high, self.zeros[plane]):
                value[some][down], value[some][up] = from_[a : a + len(down)], from_[b : b + len(up)] | bit
        return value


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def opened(path: str, blocks: int = 256) -> WaveletFile:
    """A file at a path or address that ``pyarrow.fs`` knows."""
    system, name = _file_system(path)
    return WaveletFile(system.open_input_file(name), blocks)


def _encoded(batches: Iterable[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[int | None, bytes]]:
    """Documents with their ids; ``ENCODE_CHARS`` characters or one text at a time."""
    for batch in batches:
        doc_ids, held, size, first = batch.column(0).to_pylist(), [], 0, 0
        for text in batch.column(1):
            held.append(text.as_py() or "")
            size += len(held[-1])
            if size > ENCODE_CHARS or first + len(held) == len(doc_ids):
                yield from zip(doc_ids[first : first + len(held)], encoder.encode(held))
                held, size, first = [], 0, first + len(held)


def _shards(
    documents: Iterable[tuple[int | None, bytes]], encoder: Encoder, end_id: int, shard_ids: int
) -> Iterator[tuple[list[int | None], list[int], np.ndarray]]:
    """Consecutive documents, ``shard_ids`` ids at a time."""
    doc_ids, lengths, held, size = [], [], [], 0
    end = np.array([end_id], encoder.type).tobytes()
    for doc_id, raw in documents:
        n = len(raw) // encoder.type.itemsize + 1
        if doc_ids and size + n > shard_ids:
            yield doc_ids, lengths, np.frombuffer(b"".join(held), encoder.type)
            doc_ids, lengths, held, size = [], [], [], 0
        doc_ids.append(doc_id)
        lengths.append(n)
        held += (raw, end)
        size += n
    if doc_ids:
        yield doc_ids, lengths, np.frombuffer(b"".join(held), encoder.type)


def write_shards(
    docs: DataFrame, folder: str, spec: str, *, end_id: int = END_ID, shard_ids: int = SHARD_IDS, special: bool = True
) -> DataFrame:
    """Write ``docs (doc_id, text)`` as files in ``folder`` and return the list of them.

    ``(part, shard, path, start, n_docs, n_tokens, bytes)``, where ``start`` counts the ids of
    all files before. ``folder`` must be within reach of every executor and of ``pyarrow.fs``.
    Documents are ranged by id; rows of one id are spread by the text's hash, and equal rows by
    where they were read, as their order among themselves changes nothing. Each attempt of a
    task writes under a name of its own, and only files of finished attempts are listed, so a
    repeated task does no harm. Task totals, one row a task, are summed in one window.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(spec)  # the tokenizer's file, a few MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _file_system(folder)
        part, encoder = TaskContext.get().partitionId(), encoder_of(sent.value, special)
        width = max(encoder.width, end_id.bit_length())
        rows = []
        for shard, (doc_ids, lengths, ids) in enumerate(_shards(_encoded(batches, encoder), encoder, end_id, shard_ids)):
            body = pack(doc_ids, lengths, ids, width)
            name = f"part-{part:06d}-{shard:06d}-{uuid.uuid4().hex}.gwwm"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(body)
            rows.append((part, shard, f"{folder}/{name}", len(doc_ids), len(ids), len(body)))
        if rows:
            names = ["part", "shard", "path", "n_docs", "n_tokens", "bytes"]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    placed = (
        docs.select("doc_id", "text")
        .withColumns(
            {"unknown": F.col("doc_id").isNull(), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
        )
        .repartitionByRange("unknown", "doc_id", "hash", "row")
        .sortWithinPartitions("unknown", "doc_id", "hash")
        .select("doc_id", "text")
    )
    schema = "part int, shard int, path string, n_docs long, n_tokens long, bytes long"
    listed = materialize(placed.mapInArrow(run, schema))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tasks = listed.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    tasks = tasks.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("from"))
    within = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    return materialize(
        listed.withColumn("within", within)
        .join(tasks, "part")
        .select("part", "shard", "path", (F.col("from") + F.col("within")).alias("start"), "n_docs", "n_tokens", "bytes")
    )


def _dealt(listed: DataFrame) -> DataFrame:
    """The list of files, a few for each task."""
    return listed.select("path", "start").repartition(max(1, -(-listed.count() // READ_SHARDS)))


def _files(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[WaveletFile, int]]:
    for batch in batches:
        for path, start in zip(*(c.to_pylist() for c in batch.columns)):
            system, name = _file_system(path)
            with system.open_input_file(name) as source:
                yield WaveletFile(source), start


def read_documents(listed: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """A row per document from the files: ``(doc_id, start, n_tokens, ids_crc32[, ids])``.

    ``start`` counts the ids of all documents before; the checksum is of the ids as
    little-endian unsigned 32-bit numbers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, begin in _files(batches):
            ids, at = file.all_tokens().astype("<u4"), file.starts
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [
                pa.array(file.doc_ids, pa.int64()),
                pa.array(begin + at[:-1], pa.int64()),
                pa.array(np.diff(at), pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if not with_ids:
                yield pa.RecordBatch.from_arrays(columns, names=names)
                continue
            first = 0
            while first < len(crc):  # lists go out some MB at a time
                last = max(first + 1, int(np.searchsorted(at, at[first] + COPY_BYTES // 4, "right")) - 1)
                lists = pa.ListArray.from_arrays(
                    pa.array(at[first : last + 1] - at[first], pa.int32()),
                    pa.array(ids[at[first] : at[last]].astype(np.int32)),
                )
                yield pa.RecordBatch.from_arrays([*(c[first:last] for c in columns), lists], names=[*names, "ids"])
                first = last

    return _dealt(listed).mapInArrow(run, schema)


def count_tokens(listed: DataFrame, tokens: Iterable[int]) -> DataFrame:
    """``(token, n)``: occurrences of each given id in all files, by rank alone."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, _ in _files(batches):
            counts = [file.count(t) for t in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int32()), pa.array(counts, pa.int64())], names=["token", "n"])

    return _dealt(listed).mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(listed: DataFrame, tokens: Iterable[int]) -> DataFrame:
    """``(token, doc_id, place)``: every occurrence of each given id, by its place in the document."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, _ in _files(batches):
            for token in wanted:
                at = file.places(token)
                doc = np.searchsorted(file.starts, at, "right") - 1
                columns = [
                    pa.array(np.full(len(at), token), pa.int32()),
                    pa.array([file.doc_ids[d] for d in doc], pa.int64()),
                    pa.array(at - file.starts[doc], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "doc_id", "place"])

    return _dealt(listed).mapInArrow(run, "token int, doc_id long, place long")


def encode_corpus(docs: DataFrame, tokenizer_path: str, *, folder: str | None = None, **options) -> DataFrame:
    """``docs (doc_id, text)`` written with the tokenizer file at ``tokenizer_path``; the list of files."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    folder = folder or f"{work_folder(docs.sparkSession).rstrip('/')}/gapweave/ids-{uuid.uuid4().hex}"
    return write_shards(docs, folder, spec, **options)


def from_bytes(body: bytes) -> WaveletFile:
    """A file held in memory."""
    return WaveletFile(io.BytesIO(body))
