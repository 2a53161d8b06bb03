"""Edge cases and brute force for the operators that read texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, langid, linejoin, ngramlm, packing, pii, queries, rules, simhash, winnow

SCHEMA = "doc_id long, text string, place string, cls string, key string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "p", "c", "k") for r in rows], SCHEMA)


def prose(seed, n, vocabulary=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéß") for _ in range(3)) + str(r.randrange(vocabulary)) for _ in range(n))


LONG = prose(1, 30_000, 10_000)
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (4, "One"), (None, "null id here"), (5, LONG), (6, "ÀÉ 123 $$$\n\n.")]
REF = re.compile(r"[^\x20\x09-\x0D]+")
LOW = dict(zip(range(65, 91), range(97, 123), strict=True))


def test_rules(spark):
    rows = [*EDGES, (7, prose(2, 60) + "\n" + prose(2, 60) + "\n" + prose(2, 60)), (8, "a b c " * 40), (9, prose(9, 80))]
    out = rules.quality(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    texts = Counter(t or "" for _, t in rows)
    for r in out:
        w = REF.findall(r.text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in r.text.split("\n") if REF.search(x)]
        assert r.text in texts
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in out}
    assert kept[9] and kept[5] and not kept[8] and not kept[7]
    empty = rules.quality(docs(spark, []))
    assert empty.count() == 0


def test_cascade_order_changes_nothing(spark):
    m = rules.measured(docs(spark, [*EDGES, (9, prose(9, 80)), (10, "# " * 70)]))
    verdicts = {tuple(sorted((str(r.doc_id), r.x is None) for r in m.select("doc_id", rules.cascade(order).alias("x")).collect())) for order in (rules.RULES, rules.RULES[::-1], rules.ordered(m))}
    assert len(verdicts) == 1


def test_rejected_texts_are_not_measured_again(spark):
    rows = [*EDGES, (9, prose(9, 80)), (10, "# " * 70), (11, prose(12, 90)), (None, prose(13, 70))]
    df = docs(spark, rows).withColumn("n_words", F.lit("clash"))
    kept = Counter((r.doc_id, r.text) for r in rules.quality(df).where("kept").collect())
    assert Counter((r.doc_id, r.text) for r in rules.passing(df).collect()) == kept and rules.passing(df).columns == df.columns
    trap = rules.Rule("trap", "IF(n_words < 50, CAST(raise_error('measured') AS BOOLEAN), n_repeat_words < 0)")
    assert rules.needs(trap) == ["n_words", "n_repeat_words"]
    assert Counter((r.doc_id, r.text) for r in rules.passing(df, order=[*rules.RULES, trap]).collect()) == kept
    with pytest.raises(Exception, match="measured"):
        rules.passing(df, order=[trap]).collect()
    assert rules.passing(df.where("false")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items):
    low = lambda t: WORD.findall((t or "").translate(LOW))
    wins = {}
    for i, t in items:
        w = low(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    spans = {len(x) for x in wins}
    out = []
    for t in texts:
        w, hit, ids = low(t), set(), set()
        for n in spans:
            for k in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    ids |= {str(x) for x in found if x is not None}
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_winnowing(spark):
    long_item = prose(20, 40)
    items = [(1, long_item), (2, "Short Item"), (3, "three of them"), (3, "three of them"), (None, prose(21, 20)), (4, ""), (5, None), (6, long_item), (10, "Über")]
    parts = long_item.split(" ")
    rows = [*EDGES, (7, prose(3, 30) + " " + " ".join(parts[5:18]).upper().replace("É", "é") + ", " + prose(4, 30)), (8, "x, short-item! " * 3), (9, " ".join(parts[5:17])), (11, LONG + " " + long_item + " three of them three OF them"), (12, "über Über ÜBER"), (13, prose(21, 20))]
    out = winnow.decontaminate(docs(spark, rows), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, gram string")).collect()
    want = Counter((r[0], *x) for r, x in zip(rows, brute_hits([t for _, t in rows], items), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in winnow.decontaminate(docs(spark, rows), none).collect()} == {0}
    assert winnow.decontaminate(docs(spark, []), none).count() == 0
    kept = winnow.clean(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k, n in want.items() for _ in range(n) if not k[-1])


def test_chat(spark):
    hard = "a\\b <|end|>\n</s>[INST]<| [/INST]\\<\\|<\\/s>[\\INST]"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "x"), (3, 0, "user", "only"), (None, 1, None, "n"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a"), (4, None, "us\ner", "first"), (5, 0, "assistant", LONG)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, ts string")
    ex = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_back(ex).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
        spoken = "".join(f"{x[1] or ''}\n{x[2] or ''}\n" for x in turns)
        learnt = "".join(x[2] or "" for x in turns if x[1] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert ex.where("conv_id = 1").count() == 2 and ex.where("conv_id = 3").first().loss_chars == 0
    body = ex.where("conv_id = 1").orderBy("example").first()
    inner = body.text[body.loss_start : body.loss_start + body.loss_chars]
    assert "</s>" not in inner and "[INST]" not in inner and "<|" not in inner
    assert chat.format_chat(df.where("false")).count() == 0




def test_line_dedup(spark):
    base = [prose(100 + k, 12, 500) for k in range(6)]
    near = lambda s: " ".join([*s.split(" ")[:-1], "changed"])
    rows = [(10, "\n".join(base[:3])), (11, "\n".join([base[0], near(base[1]), "new words which stand alone here today"])), (12, "short\nshort\n" + near(base[5])), (13, base[5] + "\n\n" + base[5]), *EDGES]
    out = linejoin.dedup_lines(docs(spark, rows), extra=("place",)).collect()
    assert len(out) == len(rows) and all(r.place == "p" for r in out)
    by = {r.doc_id: r for r in out}
    assert by[10].removed == [] and by[11].removed == [0, 1] and by[11].n_same == 1 and by[11].n_similar == 1
    assert by[11].text == "new words which stand alone here today"
    assert by[12].removed == [1] and by[13].removed == [0, 2]  # the earlier document is the near one
    assert by[5].text == LONG and by[1].text == "" and by[3].text == " \n\t "
    assert [r.removed for r in out if r.doc_id == 4] == [[], []]
    assert linejoin.dedup_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("tile_tokens", "family"), [(1 << 15, 256), (40, 256), (400, 3)])
def test_line_join_against_all_pairs(spark, monkeypatch, tile_tokens, family):
    monkeypatch.setattr(linejoin, "TILE_TOKENS", tile_tokens)  # 40: a tile holds few lines
    monkeypatch.setattr(linejoin, "FAMILY", family)
    monkeypatch.setattr(linejoin, "BROADCAST_LINES", tile_tokens)
    r = random.Random(3)
    lines = []
    sizes = [*[r.randint(1, 5) for _ in range(60)], *[r.randint(4, 25) for _ in range(120)], *[r.randint(50, 320) for _ in range(30)]]
    for n in sizes:
        words = [f"w{min(int(r.expovariate(0.05)), 400)}" for _ in range(n)] if n < 50 else r.sample([f"w{i}" for i in range(600)], n)
        lines.append(words)
        for _ in range(40 if n == 320 or len(lines) == 70 else r.randint(0, 2)):  # one large group of near copies
            copy = list(words)
            for _ in range(r.randint(0, max(3, n // 8))):
                copy[r.randrange(len(copy))] = f"w{r.randrange(600)}"
            lines.append(copy)
    r.shuffle(lines)
    lines = lines[: len(lines) // 6 * 6]
    rows = [(i, "\n".join(" ".join(x) for x in lines[i * 6 : i * 6 + 6])) for i in range(len(lines) // 6)]
    flat = [(i, k, frozenset(x.split(" "))) for i, t in rows for k, x in enumerate(t.split("\n"))]
    sets = list(dict.fromkeys(s for _, _, s in flat))
    links = {s: {o for o in sets if o != s and 5 * len(s & o) >= 4 * len(s | o)} for s in sets}
    first = {}
    for i, k, s in flat:
        first.setdefault(s, (i, k))
    want = {}
    for i, k, s in flat:
        if first[s] != (i, k) or any(first[o] < first[s] for o in links[s]):
            want.setdefault(i, []).append(k)
    got = {x.doc_id: x for x in linejoin.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: x.removed for i, x in got.items() if x.removed} == want
    assert sum(x.n_links for x in got.values()) == sum(len(links[s]) for i in range(len(rows)) for s in {s for j, _, s in flat if j == i} for _ in [k for j, k, z in flat if j == i and z == s])


@pytest.mark.parametrize(("tile_tokens", "family"), [(1 << 15, 256), (300, 8)])
def test_templates_against_all_pairs(spark, monkeypatch, tile_tokens, family):
    """Lines of templates with changing words of few or many values, beside other lines with the same words."""
    monkeypatch.setattr(linejoin, "TILE_TOKENS", tile_tokens)
    monkeypatch.setattr(linejoin, "FAMILY", family)
    r = random.Random(6)
    one, two = ([f"{k}{i}" for i in range(20)] for k in "tu")
    lines = [[*one, f"own{i}"] for i in range(90)] + [[*one, f"few{r.randrange(9)}", f"own{i}"] for i in range(90)] + [[*two, f"few{r.randrange(9)}", f"some{r.randrange(20)}"] for _ in range(150)]
    lines += [r.sample(one, 17) + [f"few{r.randrange(9)}"] for _ in range(30)] + [one[:10] + two[:10] for _ in range(2)] + [[*one, *[f"own{i}{k}" for k in range(i % 6)]] for i in range(40)]
    r.shuffle(lines)
    sets = list(map(frozenset, lines))
    got = {x.doc_id: x for x in linejoin.dedup_lines(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")).collect()}
    different = set(sets)
    for i, s in enumerate(sets):
        near = {o for o in different if o != s and 5 * len(s & o) >= 4 * len(s | o)}
        assert got[i].n_links == len(near)
        assert got[i].removed == ([0] if any(o == s or o in near for o in sets[:i]) else [])


def test_near_copies_are_kept_as_differences(spark):
    r = random.Random(8)
    lines = [" ".join(f"w{i}" if r.random() > 0.04 else f"w{i}x{k}" for i in range(60)) for k in range(60)]
    keyed = linejoin._keyed(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "doc_id", "text")
    classes = linejoin._lines(keyed, linejoin.rarity(keyed, "text"))
    places = linejoin._places(classes)
    blocks = linejoin._blocks(places, linejoin._sets(keyed, classes, places.select(*linejoin.CLASS).distinct()))
    n, far = blocks.where("m >= 10").select(F.explode("near.held").alias("a")).agg(F.count("*"), F.max(F.size("a.far"))).first()
    assert n >= 60 and far < 30  # a set has 60 tokens


def test_many_lines_of_one_template(spark):
    words = " ".join(f"word{i}" for i in range(20))
    lines = spark.range(20_000).selectExpr("id AS doc_id", f"concat('{words} own', id) AS text")
    out = linejoin.dedup_lines(lines).agg(F.min("n_links"), F.max("n_links"), F.sum(F.size("removed"))).first()
    assert tuple(out) == (19_999, 19_999, 19_999)


def test_contamination_by_words_with_a_final_sigma(spark):
    text = ".".join(f"ΟΔ{c}Σ" for c in "ΑΒΓΔΕΖΗΘΙΚΛΜΝ")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    (r,) = winnow.decontaminate(docs(spark, [(1, text)]), items).collect()
    assert (r.n_words, r.n_hit, r.contaminated, r.item_ids) == (13, 13, True, ["1"])


def test_short_lines_are_removed(spark):
    rows = [(1, "Read more\n\n一二三四五六\nla la la la la la\na b c d"), (2, "read  MORE\n\n一二三四五六\nla la la\na b c d e\na b c"), (3, " \na b d")]
    got = {r.doc_id: r for r in linejoin.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.removed for i, r in got.items()} == {1: [], 2: [0, 2, 3, 4], 3: []}  # 4 of 5 tokens are a match, 3 of 4 aren't
    assert (got[2].text, got[2].n_same, got[2].n_similar, got[3].text) == ("\na b c", 3, 1, " \na b d")


def test_simhash(spark):
    rows = [*EDGES, *[(20 + k, prose(7, 200)) for k in range(3)], (30, prose(7, 200) + " x"), (31, prose(8, 200)), (None, prose(8, 200))]
    out = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    prints = [(i, simhash.fingerprint(t)) for i, t in rows]
    comp = {f: f for _, f in prints}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for _, a in prints:
        for _, b in prints:
            if (a ^ b).bit_count() <= 2:
                comp[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    want = Counter((i, f"{f:016x}", least.get(root(f))) for i, f in prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == want
    kept = simhash.one_of_each(docs(spark, rows))
    assert kept.count() == len({root(f) for _, f in prints}) and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_bit_slices():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]))
    vertical = simhash.planes(fps)
    for radius in (0, 1, 2):
        for f in fps[:50]:
            got = simhash.within(int(f), vertical, np.arange(64), radius)
            assert sorted(got[got < len(fps)].tolist()) == [i for i, g in enumerate(fps) if (int(f) ^ int(g)).bit_count() <= radius]


def test_components(spark):
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(100, k) for k in range(101, 160)]
    extra = [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    edges = chain + star + extra
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    for e in extra:
        if e[0] == e[1] and all(e[0] not in x for x in edges if x[0] != x[1]):
            comp.pop(e[0], None)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(comp)


def test_lm(spark):
    rows = [*EDGES, *[(40 + k, prose(50 + k, 40)) for k in range(12)]]
    df = docs(spark, rows)
    is_train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    model = ngramlm.Model(df.where(ngramlm.seventh("doc_id") != 2), filter_bits=1 << 20, head_words=16)
    out = ngramlm.score(df, model, extra=("key",)).collect()
    toks = lambda t: [*REF.findall((t or "").translate(LOW)), None]
    c = Counter(w for i, t in rows if is_train(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.words, len(out)) == (n, v, len(rows))
    want = sorted((str(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(r.score <= 0 and r.key == "k" for r in out)
    nothing = ngramlm.Model(df.where("false"), filter_bits=1 << 20)
    assert all(r.n_known == 0 for r in ngramlm.score(df, nothing).collect())
    assert ngramlm.score(docs(spark, []), nothing).count() == 0


def test_lm_knows_pairs_seen_once(spark):
    words = prose(11, 200, 10_000).split(" ")
    turned = random.Random(1).sample(words, len(words))
    model = ngramlm.Model(docs(spark, [(1, " ".join(words))]))
    got = {r.doc_id: r for r in ngramlm.score(docs(spark, [(1, " ".join(words)), (2, " ".join(turned))]), model).collect()}
    assert got[1].base_score == pytest.approx(got[2].base_score)
    assert got[1].score > got[2].score + 1  # the same words, but each pair was seen


def test_lm_filter_grows_with_the_corpus(spark):
    rows = [*EDGES, *[(40 + k, prose(50 + k, 40)) for k in range(600)]]
    df = docs(spark, rows)
    small, large = ngramlm.Model(df.where("doc_id < 100")), ngramlm.Model(df)
    assert small.bits < large.bits and large.bits >= 8 * large.words
    joined = ngramlm.Model(df, filter_bits=1 << 10)
    assert joined.joined and not large.joined
    want, got = (Counter((r.doc_id, r.key, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in ngramlm.score(df, m, extra=("key",)).collect()) for m in (large, joined))
    assert got == want and got.total() == len(rows)


def test_levels_of_high_counts():
    counts = np.array([1, 2, 3, 4, 1 << 24, (1 << 25) - 1, 1 << 25, 1 << 40], np.int64)
    assert ngramlm.levels(counts).tolist() == [1, 2, 2, 3, 25, 25, 26, 41]
    held = ngramlm.segment(np.arange(8, dtype=np.uint64), ngramlm.levels(counts), 1 << 16)
    assert (ngramlm.probe(np.arange(8, dtype=np.uint64), held, 1) >= ngramlm.levels(counts)).all()


def test_log_frequency_filter():
    rng = np.random.default_rng(2)
    keys, other = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64)), rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    counts = rng.geometric(0.2, len(keys))
    held = ngramlm.segment(keys, ngramlm.levels(counts), 1 << 18)
    assert (ngramlm.probe(keys, held, 1) >= ngramlm.levels(counts)).all()  # never too low
    assert (ngramlm.probe(keys, held, 1) == ngramlm.levels(counts)).mean() > 0.95
    assert (ngramlm.probe(other, held, 1) > 0).mean() < 0.05


def test_language(spark):
    words = {"xx": "lorem ipsum dolor sit amet", "yy": "und der die das nicht", "zz": "école été où français"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(words[k].split(), k=30)), k) for i, k in enumerate(sorted(words) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df.where("doc_id % 4 <> 1"))
    out = {x.doc_id: x for x in langid.identify(df, net).collect()}
    held = [(out[i].lang_pred, k) for i, _, k in rows if i % 4 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    edge = langid.identify(docs(spark, EDGES), net).collect()
    assert len(edge) == len(EDGES) and all(0 <= x.score <= 1 for x in edge)
    assert {x.doc_id: x.lang_pred for x in edge if x.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert langid.train(df.where("false")) is None
    assert {x.lang_pred for x in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(docs(spark, []), net).count() == 0


def test_private_data(spark):
    texts = ["a +1 (269) 555-3296 4524132264652876 b", "me.x@mail.example.com, 10.0.0.1 and 300.1.1.1", "card 4111 1111 1111 1111.", "+12 3", "call (988) 555-2485", "v1.2.3 of 2024-01-05, 1234567", "a@b a@b..c x@y.z@w.q"]
    out = {r.doc_id: r for r in pii.find(docs(spark, [*EDGES, *[(50 + i, t) for i, t in enumerate(texts)]])).collect()}
    spans = lambda i: [(k, texts[i][int(a) : int(b)]) for k, a, b in (x.split(":") for x in out[50 + i].spans.split(",") if x)]
    assert spans(0) == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]
    assert spans(1) == [("email", "me.x@mail.example.com"), ("ip", "10.0.0.1")] and out[51].n_email == 1 and out[51].n_ip == 1
    assert ("card", "4111 1111 1111 1111") in spans(2) and spans(3) == [] and spans(4) == [("phone", "(988) 555-2485")] and spans(5) == []
    assert out[1].spans == "" and out[2].spans == "" and out[5].n_email == 0
    assert pii.find(docs(spark, [])).count() == 0
    ref = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("ab1.@-+ _é") for _ in range(r.randint(0, 30)))
        assert list(pii._emails(t)) == [(m.start(), m.end()) for m in ref.finditer(t)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_encoder(tokenizer):
    texts = ["", " ", "It's THE end... of,it!", "Σίσυφος ΣΑΣ İstanbul K", "a\tb\x1cc  d e f", "é É été ﬁ Ⅷ 12,5 ½", "<|endoftext|> x <|startoftext|>", "don't we'LL ',' '' \n\n z", "A. b, C.. 1, 2. '. \"x\", .y,z. É. Σ. <|END. <|endoftext|>. H\u0331 x\u0301. _. Ⅷ, 二, 1.", "ALL Caps, HERE. H\u0331.", LONG[:5000]]
    for got, t in zip(packing.Encoder(packing.tokenizer_path()).encode(texts), texts, strict=True):
        assert got.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID]


def test_encoder_on_random_texts(tokenizer):
    r = random.Random(6)
    alphabet = "abcABC" * 6 + "  ..,,'\n\t-_<|>" * 3 + "0123éÉßẞΣςİiKﬁⅧ二あ\u0301\u0331\u00a0\u2003½"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    for got, t in zip(packing.Encoder(packing.tokenizer_path()).encode(texts), texts, strict=True):
        assert got.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID], repr(t)


def test_encoder_meets_a_word_once(tokenizer, monkeypatch):
    e = packing.Encoder(packing.tokenizer_path())
    texts = ["Zorble%%% zorble### zorble,&&& ZORBLE. zörble!! zorb" for _ in range(50)]
    words, chunks = [], []
    monkeypatch.setattr(e, "_encode_words", lambda found, f=e._encode_words: (words.extend(found), f(found)))
    monkeypatch.setattr(e, "_encode_chunks", lambda found, f=e._encode_chunks: (chunks.extend(found), f(found)))
    got = e.encode(texts) + e.encode(texts)
    assert sorted(words) == ["zorb", "zorble", "zörble"]
    assert not any(c.isalpha() for x in chunks for c in x)
    assert all(x.tolist() == [*tokenizer.encode(texts[0], add_special_tokens=False).ids, packing.END_ID] for x in got)
    assert e.encode([]) == []


def test_foreign_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"a": 0, "?": 1}, unk_token="?"))
    plain.save(str(tmp_path / "words.json"))
    other = Tokenizer(models.BPE({"a": 0, "b": 1, "a</w>": 2, "b</w>": 3}, [], end_of_word_suffix="</w>"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.save(str(tmp_path / "bpe.json"))
    for name in ("words.json", "bpe.json"):
        with pytest.raises(ValueError):
            packing.Encoder(str(tmp_path / name))


def test_packing(spark, tokenizer):
    rows = [*EDGES, *[(60 + k, prose(k, 300)) for k in range(10)]]
    out = packing.pack(docs(spark, rows)).collect()
    want = Counter((str(i), tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    pieces = {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault(r.sequence_id, []).append(r)
    sizes = []
    for own in pieces.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        sizes.append(sum(r.length for r in own))
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    total = Counter()
    for r in out:
        total[str(r.doc_id)] += r.length
    assert total == Counter({k: sum(len(x) * n for (i, x), n in want.items() if i == k) for k in {i for i, _ in want}})
    whole = {}
    for r in sorted(out, key=lambda r: r.start):
        if str(r.doc_id) not in ("4",):
            whole.setdefault(str(r.doc_id), []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert {k: tuple(v) for k, v in whole.items()} == {i: x for i, x in want if i != "4"}
    assert packing.pack(docs(spark, [])).count() == 0


def test_hilbert_is_a_walk():
    n = 3
    grid = np.array(np.meshgrid(*[np.arange(1 << n)] * packing.DIMS, indexing="ij")).reshape(packing.DIMS, -1).T
    keys = packing.hilbert(grid << (packing.BITS - n))
    order = np.argsort(keys)
    assert len(np.unique(keys)) == len(keys)
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_columns_are_functions(spark):
    assert spark.range(1).select(chat.unescape(chat.escape(F.lit("[INST]\\<|"))).alias("x")).first().x == "[INST]\\<|"


def _plain_base(text):
    """Base spans by the plain expressions, written from their description."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(p.strip("0") == "" or (len(p.lstrip("0")) < 4 and int(p.lstrip("0")) < 256) for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])]
        if 14 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_of_random_texts():
    r = random.Random(8)
    for k in range(4000):
        t = "".join(r.choice("0123456789" * 3 + ". -+()@ab\né") for _ in range(r.randint(0, 60)))
        if k % 500 == 0:
            t = t + r.choice("07") * 5000 + ".1.1.1 +" + "4" * 5000 + " " + "0" * 5000 + ".0.00.255"
        assert pii.base_spans(t) == _plain_base(t), t[:80]


def test_private_data_survives_long_runs(spark):
    texts = ["0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1", "+" + "1" * 6000, "1 " * 6000, "a@" * 3000 + "b.c"]
    out = {r.doc_id: r for r in pii.find(docs(spark, list(enumerate(texts)))).collect()}
    assert out[0].n_ip == 1 and out[1].n_ip == 0 and len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i].n_spans == len([x for x in out[i].spans.split(",") if x]) >= len(pii.base_spans(t))


def test_decoding_takes_the_best_segmentation():
    w, t = pii.trained()
    r = random.Random(2)
    for _ in range(25):
        text = r.choice(("call +1 (269) 555-3296", "4111 1111 1111 1111", "10.0.0.1 x@y.org", "12-3456 7890 (12) 5"))[: r.randint(6, 22)]
        tokens = [m[0] for m in pii._TOKEN.finditer(text)]
        cands = {(i, j): f for i, j, f in pii._candidates(tokens)}

        def best(at, last):
            """Score and entities of the best way on from token ``at``."""
            if at == len(tokens):
                return 0.0, ()
            ways = [(t[last, pii.OUTSIDE] + (x := best(at + 1, pii.OUTSIDE))[0], x[1])]
            for (i, j), f in cands.items():
                if i == at:
                    for y in range(pii.OUTSIDE):
                        s, rest = best(j, y)
                        ways.append((t[last, y] + w[y] @ f + s, ((i, j, y), *rest)))
            return max(ways)

        score, want = best(0, pii.OUTSIDE)
        got = pii._decode(tokens, w, t)
        again, last, at, own = 0.0, pii.OUTSIDE, 0, {i: (j, y) for i, j, y in got}
        while at < len(tokens):
            j, y = own.get(at, (at + 1, pii.OUTSIDE))
            again += t[last, y] + (w[y] @ cands[at, j] if y != pii.OUTSIDE else 0)
            at, last = j, y
        assert again == pytest.approx(score) and len(got) == len(want)


@pytest.mark.parametrize("filter_bits", [1 << 30, 0])
def test_lm_score_against_counts(spark, monkeypatch, filter_bits):
    rows = [*[e for e in EDGES if e[1] != LONG], *[(40 + k, prose(50 + k, 40 + 30 * (k % 3), 20)) for k in range(80)], (200, prose(60, 40, 20))]
    df = docs(spark, rows)
    toks = lambda t: [*REF.findall((t or "").translate(LOW)), None]
    words, pairs = Counter(w for _, t in rows for w in toks(t)), Counter(p for _, t in rows for p in zip(["begin", *toks(t)], toks(t), strict=False))
    space, rounded = words.total() + len(words) + 1, lambda c: float(ngramlm.decoded(ngramlm.levels(np.array([c])))[0]) if c else 0.0

    def plain(text):
        out, last = 0.0, None
        for k, w in enumerate(toks(text)):
            before = float(len(rows)) if k == 0 else rounded(words[last])
            pair = rounded(pairs["begin" if k == 0 else last, w])
            share = 0.5 * before / (before + 50)
            out += math.log10((1 - share) * min((rounded(words[w]) + 1) / space, 1) + share * min(pair / max(before, 1), 1))
            last = w
        return out

    want = Counter((str(i), round(plain(t), 4)) for i, t in rows)
    for bits, limit in ((1 << 13, 1e-9), (8, 0.05)):  # with 8 bits an entry a few levels are too high
        monkeypatch.setattr(ngramlm, "ENTRY_BITS", bits)
        out = ngramlm.score(df, ngramlm.Model(df, filter_bits=filter_bits, head_words=20)).collect()
        if bits > 8:
            assert Counter((str(r.doc_id), round(r.score, 4)) for r in out) == want
        got, whole = sum(r.score for r in out), sum(plain(t) for _, t in rows)
        assert abs(got - whole) <= max(limit * abs(whole), 1e-6)


def test_lm_is_the_same_on_any_cluster_and_keeps_its_head_short(spark):
    rows = [(k, prose(k, 60, 30)) for k in range(200)]
    df, before, seen = docs(spark, rows), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, head in ((4, 16), (64, 0), (4, 1 << 19)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            model = ngramlm.Model(df, head_words=head)
            assert len(model.shared.value[0]) <= head
            seen.append({r.doc_id: (r.n_known, round(r.base_score, 6), r.score) for r in ngramlm.score(df, model).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_language_against_a_direct_convolution():
    rng = np.random.default_rng(3)
    texts = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in (1, 3, 4, 255, 256, 257, 509, 1500)]
    net = langid.fit([(t, k) for t, k in zip(texts * 3, "xyz" * 8, strict=True)], steps=5)
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = langid.probabilities(net, net.tables(), data, offsets)
    widths = [w for w, n in langid.FILTERS.items() for _ in range(n)]
    for t, p in zip(texts, got, strict=True):
        total, weight, start = np.zeros(3), 0, 0
        while True:  # windows that cover every place of the widest filter
            part = t[start : start + langid.LENGTH]
            padded = np.frombuffer(part.ljust(langid.LENGTH, b"\0"), np.uint8)
            top = []
            for f, w in enumerate(widths):
                kernel = net.conv[: w * langid.DIM, f]
                top.append(max(net.embed[padded[i : i + w]].ravel() @ kernel + net.bias[f] for i in range(langid.LENGTH - langid.WIDEST + 1)))
            z = np.maximum(top, 0) @ net.out + net.out_bias
            e = np.exp(z - z.max())
            total, weight = total + e / e.sum() * len(part), weight + len(part)
            if start + langid.LENGTH >= len(t):
                break
            start += langid.STEP
        assert np.allclose(p, total / weight, atol=1e-4)


def test_language_sample_is_bounded_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts: seen.append(Counter(lang for _, lang in texts)))
    rows = [(1, f"same id {k}", "xx") for k in range(50)] + [(k, f"own id {k}", "yy") for k in range(3)] + [(9, "12 34", "zz"), (10, None, "zz"), (11, "no language", None)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=20)
    assert seen == [{"xx": 20, "yy": 3}]


def test_language_sample_is_bounded_by_bytes_and_counts_copies_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", seen.append)
    rows = [(1, "one text", "xx")] * 40 + [(2, "another", "xx"), (3, "y" * 500, "xx"), (4, "z" * 60, "yy"), (5, "w" * 60, "yy")]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=10, most_bytes=100)
    (texts,) = seen
    assert [t for t in texts if t[1] == "xx"] == [(b"another", "xx"), (b"one text", "xx")] and len([t for t in texts if t[1] == "yy"]) == 1


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_queries_without_sql(spark, documents):
    from tidemark.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in documents}
    got = {n: QUERIES[n](spark, SF).collect() for n in QUERIES if n.split("_")[0] in ("op1", "op5", "op7", "op8", "op10")}
    assert all(sorted(r.doc_id for r in rows) == sorted(texts) for rows in got.values())
    held = [(r.lang_pred, d.lang) for r in got["op1_language_id"] for d in documents if d.doc_id == r.doc_id and r.held_out and d.lang and r.lang_pred != "und"]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) > 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got["op1_language_id"])
    assert {r.doc_id: r.fingerprint for r in got["op8_simhash"]} == {i: f"{simhash.fingerprint(t):016x}" for i, t in texts.items()}
    names = ("email", "ip", "card", "phone")
    for r in got["op10_pii"]:
        base = _plain_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert {f"{names[k]}:{a}:{b}" for a, k, b in base} <= set(r.spans.split(","))
    sets_of, first = {}, {}
    for i in sorted(texts):
        for k, line in enumerate(texts[i].split("\n")):
            if s := frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w):
                sets_of.setdefault(i, []).append((k, s))
                first.setdefault(s, (i, k))
    links = {s: [o for o in first if o != s and 5 * min(len(s), len(o)) >= 4 * max(len(s), len(o)) and 5 * len(s & o) >= 4 * len(s | o)] for s in first}
    for r in got["op5_line_dedup"]:
        own = sets_of.get(r.doc_id, [])
        gone = {k for k, s in own if first[s] != (r.doc_id, k) or any(first[o] < first[s] for o in links[s])}
        left = "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in gone) if gone else texts[r.doc_id]
        assert (r.n_same + r.n_similar, r.n_links) == (len(gone), sum(len(links[s]) for _, s in own))
        assert r.text_sha256 == hashlib.sha256(left.encode()).hexdigest()


def test_pii_on_sentences_held_out():
    r, (weights, moves) = random.Random(99), pii.trained()
    w = pii._Scores(weights), moves
    found = gold_n = right = 0
    for _ in range(400):
        text, gold = pii._sentence(r)
        _, got = pii.spans(text, *w)
        want = {(a, y, b) for a, b, y in gold}
        found, gold_n, right = found + len(got), gold_n + len(want), right + len(want & set(got))
    assert right / gold_n > 0.9 and right / found > 0.85, (right / gold_n, right / found)


def test_slices_are_bounded():
    texts = ["a" * 5, None, "", "b" * 30, "c", "d" * 4, "e" * 5] + ["f"] * 20
    got = list(ngramlm.slices(pa.array(texts), 8, 10))
    assert [t.encode() if t else b"" for t in texts] == [bytes(data[a:b]) for _, data, o in got for a, b in zip(o[:-1], o[1:], strict=True)]
    assert [at for at, _, _ in got] == [0, 3, 4, 7, 15, 23] and all(len(o) - 1 <= 8 and (len(d) <= 10 or len(o) == 2) for _, d, o in got)
    assert list(ngramlm.slices(pa.array([], pa.string()))) == []


def test_words_that_differ_in_a_pattern_alone(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2 ** 64."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    model = ngramlm.Model(docs(spark, [(1, word)]))
    got = {r.doc_id: r.n_known for r in ngramlm.score(docs(spark, [(1, word), (2, other), (3, word.upper()), (4, word[::-1])]), model).collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 1 + (word == word[::-1])}


def test_word_hashes():
    r = random.Random(8)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 150))) for _ in range(20_000)} | {"x" * n for n in range(1, 300)}
    texts = pa.array([f" {w}\t{w.upper() if w.isascii() else w} " for w in words])
    token, found = ngramlm.Tokens(), []
    for _, data, offsets in ngramlm.slices(texts):
        hashes, _ = token(data, offsets)
        rows = hashes.reshape(-1, 3)
        assert (rows[:, 0] == rows[:, 1]).all()
        found += rows[:, 0].tolist()
    assert len(set(found)) == len(words)


@pytest.mark.parametrize("text", ["1" * 300_000, " ".join(str(n * n) for n in range(30_000)), "abc1" * 50_000, "1." * 100_000, "a@" * 50_000, "+1 " * 50_000, "1.1.1 " * 50_000])
def test_private_data_in_linear_time(text):
    weights, moves = pii.trained()
    base, found = pii.spans(text, pii._Scores(weights), moves)
    assert set(base) <= set(found)
    assert base == _plain_base(text[:3000]) or len(text) > 3000


def test_kept_scores_are_those_of_the_features():
    weights, _ = pii.trained()
    r = random.Random(12)
    score = pii._Scores(weights)
    for _ in range(400):
        tokens = [m[0] for m in pii._TOKEN.finditer("".join(r.choice(("12", "0", ".", "255", "256", "+1", " ", "-", "call ", "4111111111111111", "(", ")")) for _ in range(12)))]
        for i in range(len(tokens)):
            for j in pii._ends(tokens, i):
                f = pii._features(tokens, i, j)
                assert score(tokens, i, j) == (None if f is None else (weights @ f).tolist())


def test_regions_decode_as_a_whole_however_they_are_read(monkeypatch):
    weights, moves = pii.trained()
    text = " ".join(f"call +1 (555) 01{k % 10}-{1000 + k} or 10.0.{k % 256}.7" for k in range(300))
    whole = pii.spans(text, pii._Scores(weights), moves)
    monkeypatch.setattr(pii, "WINDOW", 7)
    assert pii.spans(text, pii._Scores(weights), moves) == whole


def test_packing_query_keeps_every_token(spark, documents):
    """The registered query itself: pieces of a document lie end to end, sequences have no gaps and at most 2,048 tokens."""
    pieces = queries.op9_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {r.doc_id for r in documents}
    for own in by_doc.values():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) == own[0].doc_tokens
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) <= 2048


def test_rows_keep_columns_of_any_name(spark):
    """Columns named as inner ones are neither lost nor changed."""
    schema = "doc_id long, text string, _mark string, _id int, id int, mark string, row string, root int, _md5 string, n_words string, text_md5 string"
    data = [(k, prose(k % 2, 80), "m", 1, 2, "k", "r", 3, "h", "n", "t") for k in range(4)]
    df = spark.createDataFrame(data, schema)
    items = spark.createDataFrame([(1, prose(5, 20))], "item_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each(df).collect())) == data[:2] and simhash.one_of_each(df).columns == df.columns
    assert sorted(map(tuple, winnow.clean(df, items).collect())) == data and winnow.clean(df, items).columns == df.columns
    assert sorted(map(tuple, rules.passing(df).collect())) == data and rules.passing(df).columns == df.columns


def test_long_texts_have_no_say_in_the_order_of_rules(spark):
    df = docs(spark, [(k, prose(k, 30_000, 10_000)) for k in range(30)])
    assert [r.name for r in rules.ordered(df)] and rules.passing(df).count() == rules.quality(df).where("kept").count()
