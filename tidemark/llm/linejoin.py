"""Line deduplication by an exact set-similarity join.

The tokens of a line are its distinct lowered words. Lines whose token sets have a Jaccard similarity of NUM / DEN or more
are linked. Tokens are ordered by rarity; two linked lines share a token in short prefixes of that order. The first token
that they share is the one place where a pair is looked at: its position there and the lengths bound the overlap, then
parity bitmaps, then the sets themselves are compared, inside blocks of bounded size. No step has a row or an array for
each pair: semi joins keep the prefix tokens with a partner, and a block adds up how many links a line has and which is the
earliest line. Lines of one template lie in the same blocks, whose common tokens alone often link every pair.
Sets are compared by 56-bit hashes of their tokens, so results are exact up to collisions of these.
A line is removed if an earlier one (by document id, then place) is linked to it or has the same tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, let, written

#: Similarity 4 / 5.
NUM, DEN = 4, 5
#: Rarity is the count of a token's bucket, on a log scale. The table of the buckets' ranks has this fixed size.
BUCKETS = 1 << 18
#: A token is a long: 7 bits of rank, then these bits of its hash.
HASH_BITS = 56
#: Lines of more tokens get bitmaps of 128 and of 256 bits.
LONG_LINE, LONGER_LINE = 60, 200
#: Tokens in a block, about, unless one line has more.
TILE_TOKENS = 1 << 15
#: Rank of tokens with 4,096 occurrences or more.
COMMON_RANK = 36
#: Lines of a token that have this many commonest tokens in common get blocks of their own if they are so many.
KIN, FAMILY = 8, 256
#: Blocks of so many members have a reference set.
COPIES = 4
#: The list of lines whose sets are compared is broadcast up to so many; a longer one is joined by a shuffle.
BROADCAST_LINES, BROADCAST_BYTES = 400_000, 64 << 20

CLASS = ["x", "bits"]
MAPS = ["bits", "b1", "b2", "b3"]


def _plain(text: Column) -> Column:
    """``text`` lowered, its ASCII white space but line feeds as spaces."""
    low = F.lower(text)
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c")) | F.contains(text, F.lit("\r"))
    return F.when(odd, F.regexp_replace(low, "[\\t\\x0B\\f\\r]", " ")).otherwise(low)


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(docs: DataFrame, text_col: str) -> Column:
    """By bucket, the log-scaled count of its tokens over all texts, as an array of 0 to 127."""
    each = docs.select(F.explode(F.split(F.replace(_plain(F.col(text_col)), F.lit("\n"), F.lit(" ")), " ")).alias("w")).select(_bucket(F.xxhash64("w")).alias("b"))
    rank = F.least(F.floor(3 * F.log2(F.count("*") + 1)), F.lit(127)).cast("int")
    table = each.groupBy("b").agg(rank.alias("rank")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[table.column("b").to_numpy()] = table.column("rank").to_numpy()
    listed = np.array([f"{r}," for r in range(128)], "S4")[out].tobytes().replace(b"\0", b"")
    return F.split(F.lit(listed[:-1].decode()), ",").cast("array<tinyint>")  # folded to a constant


def _tokens(line: Column, ranks: Column | None = None) -> Column:
    """The distinct tokens of a plain line, rarest first; without ``ranks`` their hashes, in that order."""
    low = F.lit((1 << HASH_BITS) - 1)
    empty = F.xxhash64(F.lit(""))
    hashes = F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), empty)
    if ranks is None:
        return F.sort_array(F.transform(hashes, lambda h: h.bitwiseAND(low)))
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(F.get(ranks, _bucket(h)).cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND(low))))


def _keyed(docs: DataFrame, id_col: str, text_col: str, extra: Sequence[str] = ()) -> DataFrame:
    """``doc_id, mark, text, carried``: the id and a hash of the text say which document comes first."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"), F.struct(F.lit(True).alias("_"), *extra).alias("carried"))


def _parity(tokens: Column, chosen: int = 0) -> Column:
    """Bit b: whether an odd number of tokens have b in their last 6 bits, and ones where ``chosen`` has in the bits before."""
    one = F.lit(1).cast("long")
    picked = {0: lambda t: one, 1: lambda t: F.shiftright(t, 6).bitwiseAND(one), 2: lambda t: F.shiftright(t, 7).bitwiseAND(one), 3: lambda t: F.shiftright(t, 6).bitwiseAND(F.shiftright(t, 7)).bitwiseAND(one)}[chosen]
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", picked(t), t.bitwiseAND(F.lit(63)).cast("int"))))


def _lines(keyed: DataFrame, ranks: Column) -> DataFrame:
    """Lines with a word: place, class (by the token set), size, bitmaps, and the prefix.

    Sets too small to be linked to any other set have no prefix; lines with the same set are found by their class.
    """
    each = keyed.select("doc_id", "mark", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line_no", "line"))
    # a filter isn't pushed through a generator; else it would split the lines a second time
    each = each.select("doc_id", "mark", "line_no", F.explode(F.array(_tokens(F.col("line"), ranks))).alias("ts")).where(F.size("ts") >= 1)
    n = F.size("ts")
    prefix = F.when(DEN * n >= NUM * (n + 1), n - F.ceil(F.lit(NUM) * n / DEN).cast("int") + 1).otherwise(0)
    return each.select(
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "line_no").alias("place"),
        F.xxhash64("ts").alias("x"),
        _parity(F.col("ts")).alias("bits"),
        F.when(n > LONG_LINE, _parity(F.col("ts"), 1)).alias("b1"),
        F.when(n > LONGER_LINE, _parity(F.col("ts"), 2)).alias("b2"),
        F.when(n > LONGER_LINE, _parity(F.col("ts"), 3)).alias("b3"),
        n.alias("n"),
        F.slice("ts", F.lit(1), prefix).alias("prefix"),
    )


def _may_link() -> Column:
    """Of rows ``a`` and ``b`` of the first token that two classes share: whether what is known allows a link.

    ``left`` counts the tokens from that one on, so the smaller ``left`` bounds the overlap; each bit in which the bitmaps
    differ is a token of one side alone.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    sizes = a("n") + b("n")
    apart = lambda *maps: sum((F.bit_count(x) for x in maps), F.lit(0))
    q = {c: a(c).bitwiseXOR(b(c)) for c in MAPS}
    wide = apart(q["b1"], q["bits"].bitwiseXOR(q["b1"]))
    widest = apart(q["b3"], q["b1"].bitwiseXOR(q["b3"]), q["b2"].bitwiseXOR(q["b3"]), q["bits"].bitwiseXOR(q["b1"]).bitwiseXOR(q["b2"]).bitwiseXOR(q["b3"]))
    near = lambda d: (NUM + DEN) * d <= (DEN - NUM) * sizes
    other = (a("x") != b("x")) | (a("bits") != b("bits"))
    return ((NUM + DEN) * F.least(a("left"), b("left")) >= NUM * sizes) & near(apart(q["bits"])) & F.coalesce(near(wide), F.lit(True)) & F.coalesce(near(widest), F.lit(True)) & other


def _meets(rows: DataFrame, condition: Column) -> DataFrame:
    """The rows ``a`` with a partner ``b`` at their token; one row each, however many partners."""
    return rows.alias("a").join(rows.alias("b"), (F.col("a.token") == F.col("b.token")) & condition, "left_semi")


def _first_shared(token: Column, own: Column, other: Column) -> Column:
    """Whether ``token``, in both sorted lists, is the first that they share."""
    mine, theirs = F.get(own, F.lit(0)), F.get(other, F.lit(0))
    return F.when((token == mine) | (token == theirs), True).when(mine == theirs, False).otherwise(F.array_min(F.array_intersect(own, other)) == token)


def _places(classes: DataFrame) -> DataFrame:
    """``token, x, bits, n, left, listed``: the classes that have a possible partner at the first token that the two share.

    Where many classes of a token have met at the same earlier one, as lines of a template have, all stay: a search for one
    partner could look at all of them, and summaries of blocks tell more.
    """
    rows = classes.select(F.posexplode("prefix").alias("i", "token"), "x", *MAPS, "n").select("token", "x", *MAPS, "n", (F.col("n") - F.col("i")).alias("left"))
    # of the rows of common tokens, those whose size and position go with no other's leave before the search
    common = F.shiftright("token", HASH_BITS) >= COMMON_RANK
    seats = rows.where(common).select("token", "n", "left").distinct()
    fits = (F.col("a.token") == F.col("b.token")) & ((NUM + DEN) * F.least("a.left", "b.left") >= NUM * (F.col("a.n") + F.col("b.n")))
    seats = seats.alias("a").join(seats.alias("b"), fits, "left_semi")
    left = written(rows.where(common).join(seats, ["token", "n", "left"], "left_semi").select(*rows.columns), "common")
    # two searches, since each reads one exchange for both of its sides only as long as there is no join below
    found = written(_meets(rows.where(~common), _may_link()).unionByName(_meets(left, _may_link())), "meeting")
    dropped(left)
    # for a linked pair, the first shared token is among these tokens of either class, and none before it is in both
    listed = found.groupBy(*CLASS).agg(F.sort_array(F.collect_list("token")).alias("listed"))  # at most a prefix
    rows = written(found.join(listed, CLASS), "listed")
    dropped(found)
    # a search is in vain where all have met before: where many have the same token first, all rows stay
    head = F.get("listed", F.lit(0))
    often = rows.where(head != F.col("token")).groupBy("token", head.alias("head")).agg(F.count("*").alias("rows")).where(F.col("rows") > FAMILY)
    often = often.select("token").distinct().withColumn("often", F.lit(True))
    first = _may_link() & _first_shared(F.col("a.token"), F.col("a.listed"), F.col("b.listed"))
    rows = rows.join(often, "token", "left")
    out = written(_meets(rows, F.coalesce(F.col("a.often"), F.lit(False)) | first).select("token", *CLASS, "n", "left", "listed"), "places")
    dropped(rows)
    return out


def _sets(keyed: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``x, bits, place, ts, kin``: the token sets of the wanted classes, from the first line of each, and a hash of their commonest tokens."""
    at = classes.select(*CLASS, "place").join(wanted, CLASS, "left_semi")
    at = at.groupBy(F.col("place.doc_id").alias("d"), F.col("place.mark").alias("m")).agg(F.collect_list(F.struct(*CLASS, "place")).alias("at"))  # lines of one document
    at = written(at, "wanted")
    size = at.agg(F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size("at") * (64 + F.coalesce(F.octet_length(F.col("d").cast("string")), F.lit(0)))), F.lit(0)).alias("bytes")).first()
    few = size.n <= BROADCAST_LINES and size.bytes <= BROADCAST_BYTES
    found = keyed.select("doc_id", "mark", "text").join(F.broadcast(at) if few else at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    lines = found.select(let(F.split(_plain(F.col("text")), "\n"), lambda ls: F.transform("at", lambda w: F.struct(w.alias("w"), F.get(ls, w["place"]["line_no"]).alias("line")))).alias("of"))
    lines = lines.select(F.explode("of").alias("l")).select("l.w.*", _tokens(F.col("l.line")).alias("ts"))
    kin = F.xxhash64(F.slice("ts", F.greatest(F.size("ts") - KIN + 1, F.lit(1)), F.lit(KIN)))
    out = written(lines.groupBy(*CLASS).agg(F.first("place").alias("place"), F.first("ts").alias("ts")).withColumn("kin", kin), "sets")  # rows repeated
    dropped(at)
    return out


def _differing(a: Column, b: Column) -> Column:
    """The tokens in one of two sets alone."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _reference(held: Column) -> Column:
    """What two of three members share, which is near all members if these are copies of one line; nothing in small blocks."""
    some = [F.get(held, F.floor(k * (F.size(held) - 1) / 2).cast("int"))["ts"] for k in range(3)]
    both = [F.array_intersect(some[i], some[k]) for i, k in ((0, 1), (0, 2), (1, 2))]
    return F.when(F.size(held) >= COPIES, F.array_union(F.array_union(both[0], both[1]), both[2])).otherwise(F.array().cast("array<long>"))


def _blocks(places: DataFrame, sets: DataFrame) -> DataFrame:
    """``token, tile, near`` and a summary of each block: members of one token, of bounded size.

    Lines of one template share their commonest tokens, so where many do they get blocks of their own, in which lines with
    the same rarest tokens stay together; all others are dealt by hash. Only the few tokens with more than a block's share
    are in the tables of parts. The summary has what all members share (``core``, ``heads_core``), what any has
    (``heads_any``), the largest size and the earliest place. ``near`` is a reference set ``ref`` and the members ``held``,
    whose sets are kept as what differs from it (``far``).
    """
    kin = places.select("token", *CLASS, "n").join(sets.select(*CLASS, "kin"), CLASS).groupBy("token", "kin").agg(F.sum("n").alias("size"), F.count("*").alias("m"))
    kin = written(kin, "kin")
    parts = F.ceil(F.sum("size") / TILE_TOKENS).cast("int")
    tribes = written(kin.where(F.col("m") >= FAMILY).groupBy("token", "kin").agg(parts.alias("tribe_parts")), "tribes")
    others = written(kin.where(F.col("m") < FAMILY).groupBy("token").agg(parts.alias("parts")).where("parts > 1"), "others")
    dropped(kin)
    heads = F.slice("listed", F.lit(1), F.array_position("listed", F.col("token")).cast("int") - 1)
    members = places.join(sets, CLASS).select("token", *CLASS, "n", "left", "place", "ts", heads.alias("heads"), "kin")
    dealt = members.join(tribes, ["token", "kin"], "left").join(others, "token", "left")
    tribe = F.when(F.col("tribe_parts").isNotNull(), F.col("kin"))
    part = F.pmod(F.xxhash64(F.coalesce(F.get("heads", F.lit(0)), F.col("x"))), F.coalesce("tribe_parts", "parts", F.lit(1)))
    member = F.struct(*CLASS, "n", "left", "place", "heads", "ts")
    held = dealt.groupBy("token", F.xxhash64(tribe, part).alias("tile")).agg(F.collect_list(member).alias("held"))
    shared = lambda c: F.aggregate("held", F.get("held", F.lit(0))[c], lambda a, m: F.when(F.size(a) > 0, F.array_intersect(a, m[c])).otherwise(a))
    each = lambda c: F.transform("held", lambda m: m[c])
    member = lambda m, ref: F.struct(*[m[c].alias(c) for c in (*CLASS, "n", "left", "place", "heads")], _differing(m["ts"], ref).alias("far"))
    return held.select(
        "token",
        "tile",
        let(_reference(F.col("held")), lambda ref: F.struct(ref.alias("ref"), F.transform("held", lambda m: member(m, ref)).alias("held"))).alias("near"),
        F.size("held").alias("m"),
        shared("ts").alias("core"),
        shared("heads").alias("heads_core"),
        F.array_distinct(F.flatten(each("heads"))).alias("heads_any"),
        F.array_max(each("n")).alias("most"),
        F.array_min(each("place")).alias("least"),
    )


def _enough(a: Column | dict[str, Column], b: Column) -> Column:
    """Of two blocks' summaries, or a member's and a block's: whether what all share links every pair."""
    return (NUM + DEN) * F.size(F.array_intersect(a["core"], b["core"])) >= NUM * (a["most"] + b["most"])


def _apart(a: Column | dict[str, Column], b: Column) -> Column:
    """Whether no pair of the two has met at an earlier token."""
    return ~F.arrays_overlap(a["heads_any"], b["heads_any"])


def _not_met(heads: Column, held: Column) -> Column:
    """How many of the members ``held`` share none of the ``heads``."""
    return F.aggregate(held, F.lit(0).cast("long"), lambda n, b: n + F.when(F.arrays_overlap(heads, b["heads"]), 0).otherwise(1))


def _result(links: Column, earliest: Column) -> Column:
    return F.struct(links.cast("long").alias("links"), earliest.alias("earliest"))


def _count_links(a: Column, held: Column) -> Column:
    """How many of the members ``held`` are linked to ``a`` at their token, and the earliest; no array of them is built.

    ``far`` of either is what differs from one reference, so its tokens on one side alone are those that differ between the
    two; where both are near the reference, their sizes say enough.
    """

    def link(b: Column) -> Column:
        sizes = a["n"] + b["n"]
        long_enough = (NUM + DEN) * F.least(a["left"], b["left"]) >= NUM * sizes
        linked = lambda d: (NUM + DEN) * d <= (DEN - NUM) * sizes
        near = linked(F.bit_count(a["bits"].bitwiseXOR(b["bits"])))
        most = F.size(a["far"]) + F.size(b["far"])
        other = (a["x"] != b["x"]) | (a["bits"] != b["bits"])
        return long_enough & near & other & ~F.arrays_overlap(a["heads"], b["heads"]) & (linked(most) | linked(most - 2 * F.size(F.array_intersect(a["far"], b["far"]))))

    return F.aggregate(held, _result(F.lit(0), a["place"]), lambda n, b: F.when(link(b), _result(n["links"] + 1, F.least(n["earliest"], b["place"]))).otherwise(n))


def _found(rows: DataFrame, a: Column, result: Column) -> DataFrame:
    """``x, bits, links, earliest`` of rows with a member ``a``."""
    return rows.select(a["x"].alias("x"), a["bits"].alias("bits"), result["links"].alias("links"), result["earliest"].alias("earliest"))


def linked(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """``x, bits, links, earliest``: the classes linked to others, to how many, and the first place of these and itself.

    A block whose members share enough is linked within itself as a whole, and so are two such blocks; members are
    compared only where the summaries leave it open.
    """
    places = _places(classes)
    sets = _sets(keyed, classes, places.select(*CLASS).distinct())
    blocks = written(_blocks(places, sets), "blocks").select("*", "near.*")
    dropped(places, sets)

    held, m, least = F.col("held"), F.col("m"), F.col("least")
    enough = (NUM + DEN) * F.size("core") >= NUM * 2 * F.col("most")

    def inside(a: Column) -> Column:
        new = _not_met(a["heads"], held) - F.when(F.size(a["heads"]) == 0, 1).otherwise(0)  # without itself
        return F.when(F.size("heads_core") > 0, _result(F.lit(0), a["place"])).when(enough & (F.size("heads_any") == 0), _result(m - 1, least)).when(enough, _result(new, least)).otherwise(_count_links(a, held))

    within = blocks.where("m > 1").select(F.explode(F.transform("held", lambda a: F.struct(a["x"].alias("x"), a["bits"].alias("bits"), inside(a).alias("r")))).alias("a"))
    within = _found(within, F.col("a"), F.col("a.r"))

    several = blocks.groupBy("token").agg(F.count("*").alias("blocks")).where("blocks > 1").select("token")
    hot = blocks.join(several, "token", "left_semi")
    summary = hot.select("token", F.struct("tile", "m", "core", "heads_core", "heads_any", "most", "least").alias("s"))
    a, b = F.col("a"), F.col("b")
    pairs = summary.select("token", F.col("s").alias("a")).join(summary.select("token", F.col("s").alias("b")), "token").where("a.tile <> b.tile")
    pairs = pairs.where(~F.arrays_overlap(a["heads_core"], b["heads_core"]))  # else each pair has met at an earlier token
    pairs = pairs.select("token", a["tile"].alias("tile"), b["tile"].alias("other"), (_enough(a, b) & _apart(a, b)).alias("whole"), b["m"].alias("m"), b["least"].alias("least"))
    pairs = written(pairs, "pairs")
    sums = pairs.where("whole").groupBy("token", "tile").agg(F.sum("m").alias("links"), F.min("least").alias("earliest"))
    each = hot.select("token", "tile", "ref", F.explode("held").alias("a"))
    between = _found(each.join(sums.select("token", "tile", F.struct("links", "earliest").alias("r")), ["token", "tile"]), a, F.col("r"))

    asked = each.join(pairs.where("NOT whole").select("token", "tile", "other"), ["token", "tile"]).select("token", F.col("other").alias("tile"), "a", F.explode(F.array(_differing(a["far"], F.col("ref")))).alias("ts"))
    facing = hot.select("token", "tile", "held", "ref", F.struct("core", "heads_any", "most", "m", "least").alias("b"))
    mine = {"core": F.col("ts"), "heads_any": a["heads"], "most": a["n"]}
    facing_a = F.when(_enough(mine, b) & _apart(mine, b), _result(b["m"], b["least"])).when(_enough(mine, b), _result(_not_met(a["heads"], held), b["least"])).otherwise(let(F.struct(*[a[c].alias(c) for c in (*CLASS, "n", "left", "place", "heads")], _differing(F.col("ts"), F.col("ref")).alias("far")), lambda x: _count_links(x, held)))
    compared = _found(asked.join(facing, ["token", "tile"]).select("a", facing_a.alias("r")), a, F.col("r"))

    found = within.unionByName(between).unionByName(compared).where("links > 0")
    out = written(found.groupBy("x", "bits").agg(F.sum("links").alias("links"), F.min("earliest").alias("earliest")), "links")
    dropped(blocks, pairs)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """One row per input row: ``doc_id, text`` (what stays), ``n_lines, n_same, n_similar, n_links, removed`` (places from 0).

    ``n_same`` counts the removed lines whose token set came before, ``n_similar`` the other removed ones, ``n_links`` the
    other classes that this document's lines are linked to. Documents are ordered by id, null ids last, then by a hash of
    the text; rows equal in both are one document and get the same result. A null or empty text has one empty line, which
    stays, as do all lines without a word. Columns not named in ``extra`` are ignored, an empty table
    gives no rows. Texts and lines of any length are read whole.
    """
    keyed = _keyed(docs, id_col, text_col, extra)
    lines = written(_lines(keyed, rarity(keyed, "text")), "lines")
    whole = F.min(F.struct("place", "b1", "b2", "b3", "n", "prefix"))
    classes = written(lines.groupBy(*CLASS).agg(whole.alias("w"), F.count("*").alias("times")).select(*CLASS, "w.*", "times"), "classes")
    links = linked(keyed, classes)
    marked = classes.select(*CLASS, "times", F.col("place").alias("first")).join(links, CLASS, "left").where("times > 1 OR links > 0")
    marked = written(marked.select(*CLASS, "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce(F.col("earliest") < F.col("first"), F.lit(False)).alias("later")), "marked")
    hit = lines.select("place", *CLASS).join(marked, CLASS)
    own = hit.select("place.doc_id", "place.mark", "place.line_no", "links", (F.col("first") != F.col("place")).alias("again"), "later").distinct()
    per_doc = own.groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_list(F.when(F.col("again") | F.col("later"), F.col("line_no")))).alias("removed"),
        F.count_if("again").alias("n_same"),
        F.count_if(~F.col("again") & F.col("later")).alias("n_similar"),
        F.sum("links").cast("long").alias("n_links"),
    )
    per_doc = written(per_doc.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "removed", "n_same", "n_similar", "n_links"), "removed")
    dropped(lines, classes, links, marked)
    out = keyed.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    split = F.split("text", "\n")
    stays = F.filter(split, lambda line, i: ~F.array_contains("removed", i))
    zero = F.lit(0).cast("long")
    return out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>"))).select(
        "doc_id",
        F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(stays, "\n")).alias("text"),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce("n_same", zero).alias("n_same"),
        F.coalesce("n_similar", zero).alias("n_similar"),
        F.coalesce("n_links", zero).alias("n_links"),
        "removed",
        *[F.col("carried")[c].alias(c) for c in extra],
    )
