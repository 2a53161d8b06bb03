"""Packing of documents into training sequences along a space-filling curve.

Token counts, hashed to a vector and projected to a few dimensions, give each document a place on a Hilbert curve. A range
sort by that key puts similar documents next to each other; each range is cut into sequences as one stream. What is left
at the end of a range becomes sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SEQUENCE, END_ID = 2048, 1
#: Hash buckets of a document's vector; dimensions and bits of each on the curve.
BUCKETS, DIMS, BITS = 1024, 4, 12
#: Ids in a range, about; ranges are counted from it. Longer documents go to the ranges in parts, so that ranges of as many rows hold about as much.
RANGE_IDS, LEAST_RANGES = 5_000_000, 2
PART_IDS = 4096
#: Encoded chunks that a worker keeps in memory, twice at most; what wasn't used since the last filling goes.
CACHE = 250_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Text that is split at once, about; each of its words is looked up once.
SLICE_BYTES = 4 << 20

#: A full stop or comma between a letter or digit and a blank.
_STOP = re.compile(r"([.,])(?= )(?<=[^\W_][.,])")


#: Marks that end a word and never join it: one piece of their own for the tokenizer, unless an apostrophe is among them.
_MARKS = "".join(c for c in punctuation if c != "'")


def prepared(text: str) -> str:
    """``text`` with the same ids and fewer different chunks: where normalisation only lowers it, it is lowered and stops are parted from words."""
    text = text.replace("\n", " ")
    if "<|" in text:  # may be a control token, which is told before lowering
        return text
    low = text.lower()
    if text.isascii() or ("\u03a3" not in text and "\u0130" not in text and is_normalized("NFC", text) and is_normalized("NFC", low)):
        return _STOP.sub(r" \1", low)
    return text


#: Texts whose ids show whether a tokenizer works as ``Encoder`` takes it to.
_PROBES = ("Words, THEN  more. It's 12.5 a,b", "Été\n\nÀ é. x... '.", "one,two .", "AB ba, A.!? Ûa")


def byte_letters() -> dict[int, int]:
    """The characters that stand for bytes in byte-level tokenizers: themselves where they print, else those from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in prints)}


class Encoder:
    """Token ids of texts, chunk by chunk: the tokenizer drops blanks and line feeds and never joins what they part.

    The tokenizer also lowers case and parts letters from the marks behind them, so chunks that differ in these
    share an entry. Arrow splits the texts and names their different chunks, so Python sees each once a slice. Words of
    letters need no normalisation or splitting then and go straight to the tokenizer's model.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.bytes = self.whole.model, byte_letters()
        if not json.loads(self.whole.to_str())["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a tokenizer of words with an end-of-word suffix")
        self.always = {"": b"", "\n": array("I", [END_ID]).tobytes()}  # a line feed ends a text
        self.known: dict[str, bytes] = dict(self.always)
        self.old: dict[str, bytes] = {}
        if any(x.tolist() != [*self.whole.encode(t, add_special_tokens=False).ids, END_ID] for t, x in zip(_PROBES, self.encode(list(_PROBES)), strict=True)):
            raise ValueError(f"{path}: its words can't be encoded one by one")

    def _encode_words(self, found: list[str]) -> None:
        known, tokenize = self.known, self.model.tokenize
        for w in found:
            plain = w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes)
            known[w] = array("I", [t.id for t in tokenize(plain)]).tobytes()

    def _encode_chunks(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 4096):
            part = chunks[i : i + 4096]
            for c, e in zip(part, self.whole.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[c] = array("I", e.ids).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        known, old = self.known, self.old
        again = chunks & old.keys()
        known.update(zip(again, map(old.__getitem__, again), strict=True))
        parts: list[tuple[str, str, str]] = []
        found: set[str] = set()
        rest: set[str] = set()
        for c in chunks - again:
            core = c.rstrip(_MARKS)
            end = c[len(core) :]
            # a Greek capital sigma and a dotted capital I are lowered by rules of their own
            if core.isalpha() and (core.isascii() or (is_normalized("NFC", core) and "\u03a3" not in core and "\u0130" not in core)):
                core = core.lower()
                found.add(core)
                if core != c:
                    parts.append((c, core, end))
            else:
                rest.add(c)
        found -= known.keys()
        again = found & old.keys()
        known.update(zip(again, map(old.__getitem__, again), strict=True))
        found -= again
        self._encode_words(list(found))
        rest.update(end for _, _, end in parts if end not in known)
        self._encode_chunks(list(rest))
        for c, core, end in parts:
            known[c] = known[core] + known[end]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        split = pc.split_pattern(pa.array([prepared(t) + " \n" for t in texts], pa.string()), " ")
        coded = split.values.dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE:
            self.known, self.old = dict(self.always), self.known
        self._learn(set(chunks) - self.known.keys())
        found = [self.known[c] for c in chunks]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        of = coded.indices.to_numpy()
        n = sizes[of]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[of] - (ends - n), n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[at]
        return np.split(ids, ends[split.offsets.to_numpy()[1:-1] - 1])


def encoder(path: str) -> Encoder:
    """The worker's encoder: a Python worker runs many tasks and keeps what it has encoded.

    It is kept at the tokenizer library, a module that outlives the functions sent with each task.
    """
    import tokenizers

    held = vars(tokenizers).setdefault("_tidemark_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def projection(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 1, (BUCKETS, DIMS))


def places(ids: list[np.ndarray], project: np.ndarray) -> np.ndarray:
    """Whole coordinates of the documents, from the direction of their hashed counts."""
    spread = (np.concatenate(ids) * np.uint32(2654435761)) >> np.uint32(22)
    of = np.repeat(np.arange(len(ids)) * BUCKETS, [len(x) for x in ids])
    counts = np.bincount(of + spread, minlength=len(ids) * BUCKETS).reshape(len(ids), BUCKETS)
    p = (np.sqrt(counts) / np.sqrt(counts.sum(1, keepdims=True))) @ project  # the square roots' norm is the root of the sum
    return np.clip((p + 2) / 4 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(xs: np.ndarray) -> np.ndarray:
    """The position on the Hilbert curve of each row of coordinates of ``BITS`` bits (Skilling's transform)."""
    x = xs.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (BITS - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, curve, start, total, ids``: the place on the curve, and the ids from ``start`` on as unsigned little-endian 32-bit numbers.

    A row has ``PART_IDS`` ids at most; ``total`` is the document's.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, project = encoder(path).encode, projection()
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = encode([t or "" for t in part.column(1).to_pylist()])
                curve = np.concatenate([hilbert(places(ids[k : k + 256], project)) for k in range(0, len(ids), 256)])
                cuts = [(i, s) for i, x in enumerate(ids) for s in range(0, len(x), PART_IDS)]
                of, starts = np.array([i for i, _ in cuts]), [s for _, s in cuts]
                columns = [part.column(0).take(pa.array(of)), pa.array(curve[of], pa.int64()), pa.array(starts, pa.int64()), pa.array([len(ids[i]) for i in of], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([ids[i][s : s + PART_IDS].tobytes() for i, s in cuts], pa.binary())], ["doc_id", "curve", "start", "total", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, curve long, start long, total long, ids binary")


def tail(left: int) -> list[int]:
    """Power-of-two lengths that add up to ``left``, longest first."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    Sequences are whole (``sequence`` tokens) or of a power of two, so there is no padding; ``ids`` are the piece's ids.
    A null or empty text is its end id alone. Repeated rows are documents of their own, null ids are kept, ties on the
    curve go by id and then by ids, other columns are ignored, an empty table gives no rows. Texts are encoded whole.
    """
    path = path or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()
    ready = written(tokenized(docs, path, id_col, text_col), "tokenized")
    total = ready.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("n")).first().n // 4
    ranges = max(LEAST_RANGES, -(-total // RANGE_IDS))
    along = ready.repartitionByRange(ranges, "curve", "doc_id", "start", F.xxhash64("ids")).sortWithinPartitions("curve", "doc_id", "start", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # pieces of the sequence that isn't full yet
        filled = 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True)) if pieces else [[]] * 8
            kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            done: list[tuple] = []
            for doc, first, total, ids in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), batch.column(4), strict=True):
                data = memoryview(ids.as_buffer())
                size, start = len(data) // 4, 0
                while start < size:
                    take = min(size - start, sequence - filled)
                    held.append((doc, first + start, take, total, filled, bytes(data[4 * start : 4 * (start + take)])))
                    start, filled = start + take, filled + take
                    if filled == sequence:
                        done += [(d, s, n, zlib.crc32(x), t, number, o, x) for d, s, n, t, o, x in held]
                        held, filled, number = [], 0, number + 1
            if done:
                yield rows(done)
        done = []
        for size in tail(filled):
            offset = 0
            while offset < size:
                d, s, n, t, _, x = held.pop(0)
                take = min(n, size - offset)
                done.append((d, s, take, zlib.crc32(x[: 4 * take]), t, number, offset, x[: 4 * take]))
                if take < n:
                    held.insert(0, (d, s + take, n - take, t, 0, x[4 * take :]))
                offset += take
            number += 1
        if done:
            yield rows(done)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return along.mapInArrow(run, schema)
