"""A Merkle manifest of a dataset: leaves of rows, a tree per source, and one tree over the sources' roots.

Levels are built as tables: nodes have consecutive numbers within their group, the number divided by the fan-out is the
parent's, and the sorted hashes of a parent's children are hashed into it. Proofs go down: a level's parents are joined
with the level above by number and take over its siblings, so all joins together handle half as many rows again as there
are leaves, whatever the depth. Numbers come from a range-sorted table, so a hot source is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Siblings before and after a node, from its own level up to the root.
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: tuple[Column, ...]) -> Column:
    return digest(*map(field, fields))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``i`` and ``n``: the place of each in its group ``g`` by ``order``, from 0, and the group's size.

    A range sort deals a large group to many tasks; a row's place is its place in its task plus the rows of its group in
    the tasks before, of which there is one count for each group and task.
    """
    sort = ["g", *order]
    spread = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = written(spread.withColumn("at", F.monotonically_increasing_id()), "placed")
    counts = placed.groupBy("g", F.shiftright("at", 33).alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    before = F.array_sort(F.collect_list(F.struct("task", "first", "here")))  # tasks that hold a group: bounded by the cluster's partitions
    runs = counts.groupBy("g").agg(F.sum("here").alias("n"), before.alias("runs"))
    runs = runs.select("g", "n", F.posexplode("runs").alias("k", "run"), "runs").select(
        "g", "n", F.col("run.task").alias("task"), (F.aggregate(F.slice("runs", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, r: a + r["here"]) - F.col("run.first")).alias("shift")
    )
    tasks = placed.withColumn("task", F.shiftright("at", 33))
    out = written(tasks.join(runs, ["g", "task"]).withColumn("i", F.col("at") + F.col("shift")).drop("task", "at", "shift"), "numbered")
    dropped(placed)
    return out


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Tables of parents ``g, i, n, h, kids`` from the lowest up; ``leaves`` has ``g, i, n, h``."""
    out, below = [], leaves
    most = leaves.agg(F.max("n").alias("most")).first().most or 0
    while most > 1:
        kids = F.array_sort(F.collect_list(F.struct("i", "h")))  # FANOUT at most
        parents = below.where("n > 1").groupBy("g", F.floor(F.col("i") / FANOUT).cast("long").alias("p"), F.ceil(F.col("n") / FANOUT).cast("long").alias("m")).agg(kids["h"].alias("kids"))
        below = written(parents.select("g", F.col("p").alias("i"), F.col("m").alias("n"), F.sha2(F.array_join("kids", ""), 256).alias("h"), "kids"), "level")
        out.append(below)
        most = -(-most // FANOUT)
    return out


def tops(leaves: DataFrame, parents: list[DataFrame]) -> DataFrame:
    """``g, h``: the node that remains of each group."""
    out = leaves.where("n = 1").select("g", "h")
    for level in parents:
        out = out.unionByName(level.where("n = 1").select("g", "h"))
    return out


def _above(nodes: DataFrame, above: DataFrame | None, roots: DataFrame, keep: list[str]) -> DataFrame:
    """``nodes`` with ``subroot`` and ``path``: from their parents, or of the only node of a group from ``roots``."""
    single = nodes.where("n = 1").join(roots, "g").select(*keep, "subroot", "path")
    if above is None:
        return single
    up = above.select("g", F.col("i").alias("p"), F.col("kids").alias("run"), "subroot", F.col("path").alias("rest"))
    at = F.pmod("i", F.lit(FANOUT)).cast("int")
    join = F.array_join
    own = F.struct(join(F.slice("run", F.lit(1), at), "").alias("before"), join(F.slice("run", at + 2, F.lit(FANOUT)), "").alias("after"))
    found = nodes.where("n > 1").withColumn("p", F.floor(F.col("i") / FANOUT).cast("long")).join(up, ["g", "p"])
    return found.select(*keep, "subroot", F.concat(F.array(own), "rest").alias("path")).unionByName(single)


def proofs(leaves: DataFrame, parents: list[DataFrame], roots: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` of each leaf with ``subroot`` and ``path``; ``roots`` has ``g, subroot, path`` of the groups' last nodes.

    Tables of all levels but the lowest are deleted on the way.
    """
    above = None
    for level in parents[:0:-1]:
        known, above = above, written(_above(level, above, roots, ["g", "i", "kids"]), "proofs")
        dropped(level, *[t for t in (known,) if t is not None])
    if parents:  # the lowest is the largest, and read once
        above = _above(parents[0], above, roots, ["g", "i", "kids"])
    return _above(leaves, above, roots, keep)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, ``n_siblings``.

    ``docs`` has the columns of ``FIELDS``. Leaves of a source ascend by ``doc_id`` (null ids first), rows of one id by their
    hash, so the order of the input has no influence; repeated rows are leaves of their own. Null sources are one group,
    before all others. A null value hashes as ``-``, an empty one as ``0:``. A source of one row has its leaf as subroot, a
    table of one source its subroot as root; no siblings hash as the empty string. ``tampered``, if given, is the text that
    the row has when it's verified (null: unchanged). Texts are hashed whole; an empty table gives no rows; other columns
    are ignored.
    """
    leaf = leaf_hash(tuple(F.col(c) for c in FIELDS))
    other = F.when(tampered.isNotNull(), leaf_hash((*(F.col(c) for c in FIELDS[:-1]), tampered))) if tampered is not None else F.lit(None).cast("string")
    source = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit(""))
    hashed = written(docs.select(source.alias("g"), "doc_id", leaf.alias("h"), other.alias("other")), "leaves")
    leaves = numbered(hashed, "doc_id", "h")
    dropped(hashed)
    parents = levels(leaves)
    # the sources' roots make one more tree, of a group of its own
    subroots = written(tops(leaves, parents).select(F.lit("").alias("g"), F.col("g").alias("source"), "h"), "subroots")
    heads = numbered(subroots, "source")
    upper = levels(heads)
    crown = written(tops(heads, upper), "crown")  # one row, or none of an empty table
    last = crown.first()
    root = last.h if last else ""
    crown = crown.select("g", F.col("h").alias("subroot"), F.array().cast(PATH).alias("path"))
    roots = proofs(heads, upper, crown, ["source", "h"]).select(F.col("source").alias("g"), F.col("h").alias("subroot"), "path")
    roots = written(roots, "roots")
    dropped(subroots, heads, *upper[:1])
    out = proofs(leaves, parents, roots, ["doc_id", "h", "other"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("other", "h"), F.col("path")).alias("folded_root"), (F.length(siblings) / 64).cast("int").alias("n_siblings"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
