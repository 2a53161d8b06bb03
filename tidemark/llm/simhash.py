"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit set where more than half of its shingles' hashes do. Two fingerprints within the radius
agree on all but ``RADIUS`` of ``BANDS`` bands, so every choice of agreeing bands is a block key, and each link lies in a
block. Inside a block, bit planes are stored vertically; carry-save counters add the differing planes of 64 fingerprints at
a time, and words whose fingerprints all exceed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

RADIUS, SHINGLE, SEED = 2, 3, 42
#: 8 bands of 8 bits: fingerprints within 2 bits agree on 6 of them, so a block holds 2 ** 16 different ones at most.
BANDS = 8
_WIDTH = 64 // BANDS


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Of the text's shingles of ``size`` words, repeats included; of its words if they are fewer; zero without words."""
    import re

    import xxhash

    table = dict(zip(range(65, 91), range(97, 123), strict=True))
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), SEED) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _fingerprint(data: bytes, size: int, digest) -> int:
    """As ``fingerprint``, of lowered UTF-8."""
    ws = data.split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= size:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(ws) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], "<u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, mark``: the fingerprint as a signed long, and a hash of the text. One row per input row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
        for batch in batches:
            out = [_fingerprint((t.as_py() or "").encode().translate(lower), size, xxh64_intdigest) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64)), batch.column(2)], ["doc_id", "fp", "mark"])

    # bytes.split() parts at the six ASCII blanks, and nowhere inside a UTF-8 character
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark")).mapInArrow(run, f"doc_id {kind}, fp long, mark long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word."""
    n = len(fps)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def within(fp: int, vertical: np.ndarray, order: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Indices of the fingerprints in ``vertical`` at ``radius`` bits or fewer from ``fp``; planes are added in ``order``.

    Carry-save counters: ones, twos and an overflow that stays. A word whose 64 lanes have all overflowed is abandoned.
    """
    live = np.arange(vertical.shape[1])
    ones = np.zeros(len(live), np.uint64)
    twos, over = np.zeros_like(ones), np.zeros_like(ones)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k, b in enumerate(order):
        differ = vertical[b, live] if not fp >> int(b) & 1 else ~vertical[b, live]
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos |= carry
        if radius < 3:
            over |= twos & ones if radius == 2 else (twos if radius == 1 else twos | ones)
        if k % 8 == 7:
            keep = over != full
            if not keep.all():
                live, ones, twos, over = live[keep], ones[keep], twos[keep], over[keep]
                if not len(live):
                    return live
    lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(lanes)
    return live[word] * 64 + lane


def block_links(fps: np.ndarray, shared: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints that agree on the bits in ``shared``.

    Each fingerprint is reached once from another, so a block gives fewer links than it has fingerprints.
    """
    n = len(fps)
    vertical = planes(fps)
    order = np.array([b for b in range(64) if not shared >> b & 1])
    todo, out = np.ones(n, bool), []
    for first in range(n):
        if not todo[first]:
            continue
        todo[first] = False
        stack = [first]
        while stack:
            i = stack.pop()
            near = within(int(fps[i]), vertical, order)
            near = near[near < n]
            near = near[todo[near]]
            todo[near] = False
            out += [(int(fps[i]), int(fps[j])) for j in near]
            stack += near.tolist()
    return out


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links that connect what lies within the radius, among the different fingerprints in column ``fp``."""
    masks = [sum(((1 << _WIDTH) - 1) << (_WIDTH * b) for b in own) for own in combinations(range(BANDS), BANDS - RADIUS)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(signed)])).alias("x"))
    keyed = keyed.select("x.choice", "x.part", "fp")
    keyed = keyed.repartition("choice", "part").sortWithinPartitions("choice", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        last = False
        source = iter(batches)
        while not last:
            batch = next(source, None)
            last = batch is None
            if not last:
                held = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for k, h in enumerate(held)]
            choice, part, fp = held
            if not len(fp):
                continue
            cuts = np.flatnonzero((np.diff(choice) != 0) | (np.diff(part) != 0)) + 1
            bounds = np.concatenate([[0], cuts, [len(fp)]])
            if not last:
                bounds = bounds[:-1]  # the last block may go on in the next batch
            out: list[tuple[int, int]] = []
            for g in np.flatnonzero(np.diff(bounds) > 1):
                a, b = bounds[g], bounds[g + 1]
                out += block_links(fp[a:b].view(np.uint64), masks[choice[a]])
            held = [h[bounds[-1] :] for h in held]
            if out:
                ends = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges`` (``a, b``): every node of a component has the same root.

    Each round hooks every node to its smallest neighbour, follows these hooks to their ends, and keeps the edges between
    different ends; each round at least halves what is left. Every round is written to the shared folder.
    """
    edges = written(edges.where("a <> b"), "edges")
    label = None
    while edges.take(1):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        hook = written(both.groupBy("node").agg(F.min("near").alias("root")).withColumn("root", F.least("node", "root")), "hooks")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            step = written(hook.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "hooks")
            hook = step.select("node", "root")
            if not step.where("moved").take(1):
                break
        if label is None:
            label = hook
        else:
            to = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            label = written(label.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        left, right = hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id, root, mark`` (a hash of the text).

    ``component_id`` is the smallest id reachable over links of ``RADIUS`` bits or fewer, itself included; null if all ids
    there are null. ``root`` tells components apart whatever their ids. Null and empty texts have fingerprint zero and link
    like any other. Repeated rows and ids are rows of their own; other columns are ignored; an empty table gives no rows.
    Texts of any length are read whole.
    """
    own = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(links(distinct.select("fp")))
    rooted = distinct.join(label.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "components")
    return own.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root", "mark")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component that of the smallest id, null last, and of rows with
    that id that of the smallest hash of the text; of rows equal in both any one. Nulls, long texts and empty tables are as
    in ``near_duplicates``; columns of any name are kept."""
    found = near_duplicates(docs, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("x"))
    keep = first.select(F.col("x.doc_id").alias("_id"), F.col("x.mark").alias("_mark"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # so that no column's name can clash
    rows = docs.select(whole.alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("mark"))
    kept = rows.join(keep, rows["id"].eqNullSafe(keep["_id"]) & (rows["mark"] == keep["_mark"]), "left_semi")
    return kept.dropDuplicates(["id", "mark"]).select("row.*")
