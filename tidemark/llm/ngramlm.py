"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs over the training rows are quantised to powers of two. An n-gram of level L enters the filter
L times, once with each of 1 to L; probing 1, 2, ... until a miss gives the level back. The filter consists of segments by
hash, so each task of the counting builds the segments of its own n-grams, in the size that their entries need. It is
broadcast up to a bound; a larger one stays in its segments, and the n-grams of the texts come to them by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Bits and probes for each entry of the filter.
ENTRY_BITS, PROBES = 8, 2
#: A filter of more bits (128 MB) isn't broadcast but joined.
BROADCAST_BITS = 1 << 30
#: Bytes of training text for each segment of the filter, about; at least so many segments.
SEGMENT_BYTES, LEAST_SEGMENTS = 8 << 20, 16
#: Covers any 64-bit count.
MAX_LEVEL = 64
#: Exact counts of so many words, the most frequent ones, are broadcast; those of the others come by a join.
HEAD_WORDS = 1 << 19
#: Share of the pair model in the interpolation after a frequent word; half of it after a word of count PAIR_HALF.
PAIR_WEIGHT, PAIR_HALF = 0.5, 50
#: Texts whose tokens are looked up at once, and the bytes of these unless one is longer; where the filter is joined, bytes of text that ask together, and more than the rows these can have.
SLICE, SLICE_BYTES = 256, 1 << 20
ASK_BYTES, ASK_ROWS = 4 << 20, 1 << 14
#: Tokens counted at once by a task.
FLUSH = 2_000_000

_U = np.uint64
#: Values of bytes are kept for so many places in a word, and computed beyond.
PLACES = 64
END, BEGIN = _U(0x2545F4914F6CDD1D), _U(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Tokens:
    """Hashes of the tokens of texts that lie one after another in UTF-8: words between ASCII blanks, A-Z lowered, then an end.

    A word's hash is the mixed sum of a value for each byte at its place and the length. As these values have no relation to
    one another, words collide by chance alone, as any 64-bit hashes do.
    """

    def __init__(self) -> None:
        codes = np.arange(256)
        lowered = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
        self.value = mix(lowered.astype(np.uint64) + _U(1))
        self.word = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
        self.at_place = self._placed(np.repeat(np.arange(PLACES), 256), np.tile(codes, PLACES))

    def _placed(self, place: np.ndarray, data: np.ndarray) -> np.ndarray:
        return mix(self.value[data] + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, and where each text's tokens begin."""
        n, texts = len(data), len(offsets) - 1
        inside = self.word[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        length = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1 - begin
        first = np.concatenate([[0], np.cumsum(length)])  # of each word, among the bytes of words
        letters = data[inside]
        place = np.arange(len(letters)) - np.repeat(first[:-1], length)
        values = self.at_place[np.minimum(place, PLACES - 1) * 256 + letters]
        far = np.flatnonzero(place >= PLACES)
        values[far] = self._placed(place[far], letters[far])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        words = mix(total[first[1:]] - total[first[:-1]] + length.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        before = np.searchsorted(begin, offsets)
        out = np.empty(len(words) + texts, np.uint64)
        firsts = before + np.arange(texts + 1)
        ends = firsts[1:] - 1
        is_end = np.zeros(len(out), bool)
        is_end[ends] = True
        out[is_end] = END
        out[~is_end] = words
        return out, firsts


def pairs(tokens: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it in its text."""
    before = np.concatenate([[BEGIN], tokens[:-1]]) if len(tokens) else tokens
    before[firsts[:-1]] = BEGIN
    return mix(before * _U(3) + mix(tokens))


def slices(texts: pa.Array, size: int = SLICE, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position, bytes and offsets of runs of ``size`` texts or ``most`` bytes, at least one text each; null is empty."""
    texts = texts.cast(pa.large_binary())
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = upto[at - 1] if at else 0
        end = max(at + 1, min(at + size, int(np.searchsorted(upto, before + most, "right"))))
        part = texts.slice(at, end - at).fill_null(b"")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        yield at, data, offsets - offsets[0]
        at = end


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(counts, 1).astype(np.float64))[1].astype(np.int64), MAX_LEVEL)


def decoded(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range; 0 for none."""
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 1.5 * 2.0 ** (level - 1)))


def _at(keys: np.ndarray, level: int, probe: int, bits: int | np.ndarray) -> np.ndarray:
    step = 0x9E3779B97F4A7C15 * (level * PROBES + probe + 1) % (1 << 64)
    return (mix(keys + _U(step)) >> _U(32)) * np.asarray(bits).astype(np.uint64) >> _U(32)


def segment_bits(level: np.ndarray) -> int:
    """The size of a segment for keys of these levels, in whole 64-bit words."""
    return max(64, -(-ENTRY_BITS * int(level.sum()) // 64) * 64)


def segment(keys: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits that holds the keys at their levels."""
    out = np.zeros(bits, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        keys, level = keys[level >= j], level[level >= j]
        for p in range(PROBES):
            out[_at(keys, j, p, bits)] = True
    return np.packbits(out, bitorder="little")


def bucket_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys >> _U(64 - (segments.bit_length() - 1))).astype(np.int64) if segments > 1 else np.zeros(len(keys), np.int64)


def probe(keys: np.ndarray, filter_bytes: np.ndarray, segments: int, edges: np.ndarray | None = None) -> np.ndarray:
    """Levels of the keys, by membership probes until the first miss. Segments lie between ``edges`` (bytes), or are of one size."""
    if edges is None:
        edges = np.arange(segments + 1) * (len(filter_bytes) // segments)
    bucket = bucket_of(keys, segments)
    start, bits = (8 * edges[bucket]).astype(np.uint64), (8 * np.diff(edges)[bucket]).astype(np.uint64)
    out = np.zeros(len(keys), np.int64)
    alive = np.arange(len(keys))
    for j in range(1, MAX_LEVEL + 1):
        for p in range(PROBES):
            place = start[alive] + _at(keys[alive], j, p, bits[alive])
            alive = alive[(filter_bytes[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1]
        if not len(alive):
            break
        out[alive] = j
    return out


def _counted(docs: DataFrame, segments: int) -> DataFrame:
    """``kind, bucket, keys, counts``: what each task counted; kind 1 for words and 2 for pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of, held, n = Tokens(), ([], []), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                keys, counts = np.unique(np.concatenate(held[kind]), return_counts=True)
                held[kind].clear()
                cuts = np.searchsorted(bucket_of(keys, segments), np.arange(segments + 1))
                full = np.flatnonzero(np.diff(cuts))
                counts = counts.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(full), kind + 1, np.int32)),
                        pa.array(full.astype(np.int32)),
                        pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                        pa.array([counts[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
                    ],
                    ["kind", "bucket", "keys", "counts"],
                )

        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                t, firsts = tokens_of(data, offsets)
                held[0].append(t)
                held[1].append(pairs(t, firsts))
                n += len(t)
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    return docs.mapInArrow(run, "kind int, bucket int, keys binary, counts binary")


def _merged(counted: DataFrame) -> DataFrame:
    """Per kind and bucket: the keys with their exact counts (words only), and the bucket's filter."""

    def merge(kind: int, bucket: int, keys: list[bytes], counts: list[bytes]) -> tuple:
        k, c = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(counts), np.uint32)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k, c = k[first], np.add.reduceat(c, first)
        level = levels(c)
        inside = segment(k, level, segment_bits(level)).tobytes()
        return (kind, bucket, None, None, inside) if kind == 2 else (kind, bucket, k.view(np.int64), c, inside)

    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("segment", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        keys: list[bytes] = []
        counts: list[bytes] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(merge(*now, keys, counts), schema, strict=True)], schema=schema)

        for batch in batches:
            for kind, bucket, k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is not None and now != (kind, bucket):
                    yield row()
                    keys, counts = [], []
                now = (kind, bucket)
                keys.append(k)
                counts.append(c)
        if now is not None:
            yield row()

    return counted.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(run, "kind int, bucket int, words array<long>, counts array<long>, segment binary")


class Model:
    """What scoring needs: the totals, the filters, the counts of frequent words, and the table of the others' counts."""

    def __init__(self, train: DataFrame, text_col: str = "text", filter_bits: int = BROADCAST_BITS, head_words: int = HEAD_WORDS):
        spark = train.sparkSession
        rows = train.select(F.col(text_col).cast("string").alias("text"))
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
        self.segments = 1 << max(LEAST_SEGMENTS, -(-size // SEGMENT_BYTES) - 1).bit_length()  # by the corpus alone: the filter is the same on any cluster
        merged = written(_merged(_counted(rows, self.segments)), "ngrams")
        self.counts = merged.where("kind = 1").select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
        total = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.words = total.n, total.v
        self.texts = self.counts.where(F.col("word") == int(END.view(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        head = np.array([tuple(r) for r in self._head(head_words)], np.int64).reshape(-1, 2)
        head = head[np.argsort(head[:, 0].view(np.uint64))]
        self.filter = merged.select("kind", "bucket", "segment")
        self.bits = 8 * self.filter.agg(F.coalesce(F.sum(F.octet_length("segment")), F.lit(0)).alias("n")).first().n
        self.joined = self.bits > filter_bits
        filters = [] if self.joined else self._whole()
        self.shared = spark.sparkContext.broadcast((np.ascontiguousarray(head[:, 0]).view(np.uint64), head[:, 1].copy(), *filters))

    def _whole(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The filters of words and pairs, each with the edges of its segments; an empty segment has one word of bits."""
        sizes = np.full((2, self.segments), 8, np.int64)
        for r in self.filter.select("kind", "bucket", F.octet_length("segment").alias("n")).toLocalIterator():
            sizes[r.kind - 1, r.bucket] = r.n
        edges = [np.concatenate([[0], np.cumsum(x)]) for x in sizes]
        bits = [np.zeros(e[-1], np.uint8) for e in edges]
        for batch in self.filter.toArrow().to_batches():
            for kind, bucket, held in zip(*batch.columns, strict=True):
                k, at = kind.as_py() - 1, edges[kind.as_py() - 1][bucket.as_py()]
                bits[k][at : at + len(held.as_buffer())] = np.frombuffer(held.as_buffer(), np.uint8)
        return list(zip(bits, edges, strict=True))

    def _head(self, limit: int) -> list:
        """The most frequent words, ``limit`` at most: those above the least count for which they fit; none if the topmost don't."""
        step = F.floor(F.log2("n") * 8).cast("int")
        by_step = self.counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # 8 * 64 rows at most
        self.least, have = (1 << 63) - 1, 0
        for r in by_step:
            have += r.words
            if have > limit:
                break
            self.least = r.least
        return self.counts.where(F.col("n") >= self.least).toArrow().to_pandas().to_numpy()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, payload``: runs of rows with about ``ASK_BYTES`` of text, numbered."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 28
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // ASK_BYTES
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(upto)) + 1, np.arange(0, batch.num_rows, ASK_ROWS), [batch.num_rows]])).tolist()
        for a, b in pairwise(cuts):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "payload"])
            part += 1


def _unpacked(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as found:
        return found.read_next_batch()


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with the same key."""
    rows = (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist())
    return ((k, list(g)) for k, g in groupby(rows, lambda r: r[key]))


def _joined_levels(parts: DataFrame, model: Model) -> DataFrame:
    """``part, kind, bucket, payload``: the levels, a byte each, of a slice's distinct n-grams of a segment in order of their hashes."""
    segments = model.segments

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = Tokens()
        for part, (row,) in _groups(batches, "part"):
            (_, data, offsets), = slices(_unpacked(row["payload"]).column(1), ASK_ROWS, 1 << 62)
            t, firsts = tokens_of(data, offsets)
            for kind, keys in ((1, np.unique(t)), (2, np.unique(pairs(t, firsts)))):
                cuts = np.searchsorted(bucket_of(keys, segments), np.arange(segments + 1))
                full = np.flatnonzero(np.diff(cuts))
                columns = [np.full(len(full), kind, np.int32), full.astype(np.int32), np.full(len(full), part, np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())], ["kind", "bucket", "part", "payload"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside = None, np.zeros(8, np.uint8)
        for batch in batches:
            out = []
            for key, rows in groupby(batch.to_pylist(), lambda r: (r["kind"], r["bucket"])):
                if key != at:
                    at, inside = key, np.zeros(8, np.uint8)
                asks = []
                for r in rows:
                    if r["part"] < 0:
                        inside = np.frombuffer(r["payload"], np.uint8)
                    else:
                        asks.append(r)
                level = probe(np.frombuffer(b"".join(r["payload"] for r in asks), np.uint64), inside, 1).astype(np.uint8)  # a bucket's slices at once
                ends = np.cumsum([0, *(len(r["payload"]) // 8 for r in asks)])
                out += [r | {"payload": level[i:j].tobytes()} for r, i, j in zip(asks, ends[:-1], ends[1:], strict=True)]
            if out:
                yield pa.RecordBatch.from_pylist(out, batch.schema)

    asks = parts.mapInArrow(asked, "kind int, bucket int, part long, payload binary")
    held = model.filter.select("kind", "bucket", F.lit(-1).cast("long").alias("part"), F.col("segment").alias("payload"))  # before the slices
    both = asks.unionByName(held).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "part")
    return both.mapInArrow(answered, "kind int, bucket int, part long, payload binary").select("part", "kind", "bucket", "payload")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, the ``extra`` columns, ``n_tokens, n_known, base_score, score``.

    ``base_score`` takes exact counts; ``score`` is the log10 probability under the interpolated pair model of the filter.
    A null or empty text is its end token alone. Repeated rows get the same result, null ids are kept, other columns are
    ignored, an empty table gives no rows; without training rows all counts are 0. Texts are scored whole.
    """
    shared, segments, texts = model.shared, model.segments, max(model.texts, 1)
    space = float(model.tokens + model.words + 1)
    inputs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    out_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema if f.name != "text")

    def measured(batch: pa.RecordBatch, row: int, t: np.ndarray, firsts: np.ndarray, word_level: np.ndarray, pair_level: np.ndarray) -> pa.RecordBatch:
        """The rows of ``batch``, whose tokens have these levels; their numbers begin with ``row``."""
        head, head_n = shared.value[:2]
        kept = [k for k, f in enumerate(batch.schema) if f.name != "text"]
        n, begins = len(firsts) - 1, firsts[:-1]
        known, back = np.unique(t, return_inverse=True)
        place = np.minimum(np.searchsorted(head, known), max(len(head) - 1, 0))
        is_head = head[place] == known if len(head) else np.zeros(len(known), bool)
        count = np.where(is_head, head_n[place] if len(head) else 0, 0)
        in_head, c = is_head[back], count[back]
        base = np.where(in_head, np.log10((c + 1) / space), 0.0)
        word_level, pair_level = decoded(word_level)[back], decoded(pair_level)
        before = np.concatenate([[0.0], word_level[:-1]])
        before[begins] = texts
        share = PAIR_WEIGHT * before / (before + PAIR_HALF)
        p = (1 - share) * np.minimum((word_level + 1) / space, 1) + share * np.minimum(pair_level / np.maximum(before, 1), 1)
        tail = t[~in_head].view(np.int64)
        in_tail = np.concatenate([[0], np.cumsum(~in_head)])[firsts]
        return pa.RecordBatch.from_arrays(
            [
                *(batch.column(k) for k in kept),
                pa.array(row + np.arange(n)),
                pa.array(np.diff(firsts)),
                pa.array(np.add.reduceat(in_head, begins, dtype=np.int64)),
                pa.array(np.add.reduceat(base, begins)),
                pa.array(np.add.reduceat(np.log10(p), begins)),
                pa.ListArray.from_arrays(pa.array(in_tail.astype(np.int32)), pa.array(tail)),
            ],
            [*(batch.schema[k].name for k in kept), "row", "n_tokens", "n_head", "base", "score", "tail"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (word_filter, word_edges), (pair_filter, pair_edges) = shared.value[2:]
        tokens_of, row = Tokens(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                t, firsts = tokens_of(data, offsets)
                part = batch.slice(at, len(firsts) - 1)
                word_level = probe(np.unique(t), word_filter, segments, word_edges)
                yield measured(part, row, t, firsts, word_level, probe(pairs(t, firsts), pair_filter, segments, pair_edges))
                row += part.num_rows

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = Tokens()
        for part, (rows, *found) in _groups(batches, "part"):
            batch = _unpacked(rows["payload"])
            (_, data, offsets), = slices(batch.column(1), ASK_ROWS, 1 << 62)
            t, firsts = tokens_of(data, offsets)
            of = [np.frombuffer(b"".join(x["payload"] for x in found if x["kind"] == kind), np.uint8) for kind in (1, 2)]
            yield measured(batch, part * ASK_ROWS, t, firsts, of[0], of[1][np.unique(pairs(t, firsts), return_inverse=True)[1]])

    out_types = f"{out_types}, row long, n_tokens long, n_head long, base double, score double, tail array<long>"
    if model.joined:
        parts = written(inputs.mapInArrow(_packed, "part long, payload binary"), "parts")
        levels_of = written(_joined_levels(parts, model), "levels")
        both = parts.select("part", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), "payload").unionByName(levels_of)
        scored = written(both.repartition("part").sortWithinPartitions("part", "kind", "bucket").mapInArrow(run_joined, out_types), "scored")
        dropped(parts, levels_of)
    else:
        scored = written(inputs.mapInArrow(run, out_types), "scored")
    rest = scored.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    others = model.counts.where(F.col("n") < model.least)
    rest = rest.join(others, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(space))).alias("rest"),
    )
    whole = scored.drop("tail").join(rest, "row", "left")
    return whole.select(
        "doc_id", *extra, "n_tokens", (F.col("n_head") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score"
    )


def seventh(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7))
