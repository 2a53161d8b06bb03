"""Merkle manifest, whitening and HTML extraction: edge cases, brute force and generated truth."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, rows
from tidemark.llm import htmltext, merkle, queries, sql, whitening

SF = "/root/testdata/sf0.001"

# Merkle.

LEAVES = "doc_id long, source string, lang string, n_chars long, text string, g string, i long, kids string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(hashes):
    """The root and each leaf's siblings before and after it, level by level."""
    paths, own = [[] for _ in hashes], [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        above, owned = [], []
        for a in range(0, len(hashes), 3):
            run = hashes[a : a + 3]
            for k in range(len(run)):
                for m in own[a + k]:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            owned.append(sum(own[a : a + 3], []))
        hashes, own = above, owned
    return hashes[0], paths


def brute_manifest(data):
    """(doc_id, leaf, subroot, root, proof digest, folded root) of all rows, counted."""
    by = {}
    for r in data:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        ordered = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = (ordered, *tree([leaf(r, r[4]) for r in ordered]))
    root, upper = tree([trees[s][1] for s in sources])
    out = Counter()
    for s, top in zip(sources, upper, strict=True):
        ordered, subroot, paths = trees[s]
        for r, path in zip(ordered, paths, strict=True):
            whole, text = path + top, r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf(r, text)
            for a, b in whole:
                h = sha(a, h, b)
            out[r[0], leaf(r, r[4]), subroot, root, sha(*(a + b for a, b in whole)), h, h == root] += 1
    return out


def run_manifest(spark, data):
    docs = spark.createDataFrame([(*r, "g", 1, "k") for r in data], LEAVES).repartition(3)
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    found = merkle.manifest(docs, F.when(even, F.translate("text", "\n", ""))).collect()
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found)


EDGES = [
    (1, None, None, None, None), (2, None, "en", 3, "a\nb"), (3, "", "en", 0, ""), (4, "x", "", 5, "ü\n"), (4, "x", "", 5, "ü\n"), (4, "x", "", 5, "other"),
    (None, "x", "en", 1, "null\nid"), (None, None, None, None, None), (6, "éa", "en", 2, "line\n" * 50_000), (7, "only", "de", 1, "x"),
]


def test_manifest_edges(spark):
    data = EDGES + [(k, "hot", "en", k, f"t{k}\n") for k in range(100, 190)]
    assert run_manifest(spark, data) == brute_manifest(data)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_manifest_sizes(spark, n):
    data = [(k, f"s{k % 2 if n > 5 else k}", "en", k, f"t{k}\n") for k in range(n)]
    assert run_manifest(spark, data) == brute_manifest(data)


def test_manifest_finds_each_change(spark):
    data = [(k, f"s{k % 3}", "en", k, f"text {k}") for k in range(40)]
    docs = spark.createDataFrame([(*r, "g", 1, "k") for r in data], LEAVES)
    out = merkle.manifest(docs, F.when(F.col("doc_id") == 17, F.lit("text 71"))).collect()
    assert [r.doc_id for r in out if not r.verified] == [17]


def test_manifest_empty(spark):
    assert run_manifest(spark, []) == Counter()


def test_manifest_query(spark):
    got = queries.op11_merkle(spark, SF).toPandas()
    assert rows(got) == rows(connect(SF).sql(sql.ORACLE_SQL["op11_merkle"]).df())


# Whitening.

VECTORS = "vec_id long, embedding array<float>, x string, component int, part string"


def vectors(spark, data):
    return spark.createDataFrame([(i, v, "x", 1, "p") for i, v in data], VECTORS).repartition(3)


def grid(values):
    return np.floor(64 * np.asarray(values, np.float32).astype(float)).astype(np.int64) + 1_000_000


def brute_whiten(data):
    """By vec_id: deviation, whitened values up to sign; n and shares."""
    x = np.stack([grid(v) for _, v in data])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    y = fit - sums / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    keep = e > 1e-11 * e.sum()
    e, u = e[keep], u[:, keep]
    return ((n * x - sums) ** 2).sum(1), (x - sums / n) @ u / np.sqrt(e), n, e / np.trace(y.T @ y / n)


def test_whitening(spark):
    r = np.random.default_rng(4)
    base = (r.normal(size=(90, 20)) * np.linspace(0.2, 3, 20)).astype(np.float32)
    good = [(k, base[k % 60].tolist()) for k in range(200)] + [(7, base[3].tolist())] * 3 + [(None, base[4].tolist())]
    bad = [(900, None), (901, []), (902, [1.0] * 3), (903, [None] + [1.0] * 19), (904, [float("nan")] * 20), (905, [float("inf")] + [0.0] * 19), (906, [3e38] * 20)]
    out = whitening.whiten(vectors(spark, good + bad)).collect()
    deviation, white, n, share = brute_whiten(good)
    assert {r.n for r in out} == {n} and n == 60
    assert Counter((r.vec_id, r.component, r.deviation) for r in out) == Counter((i, c, int(d)) for (i, _), d in zip(good, deviation, strict=True) for c in range(1, 17))
    got = {(r.vec_id, r.component, r.deviation): r.whitened for r in out}
    signs = {}
    for (i, _), d, w in zip(good, deviation, white, strict=True):
        for c in range(16):
            value = got[i, c + 1, int(d)]
            assert abs(value - w[c] * signs.setdefault(c, 1 if value * w[c] > 0 else -1)) < 1e-9
    assert max(abs(r.explained - share[r.component - 1]) for r in out) < 1e-12
    assert {r.identity_error for r in out}.pop() < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)])).collect()
    assert len(line) == 9 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_deviations_beyond_longs():
    x = np.array([[1 << 40, 3], [5, 1 << 30], [1, 2]], np.int64)
    sums = [int(v) for v in x.sum(0)]
    centre = np.array([s // 3 for s in sums])
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, 3, sums, centre) == [w if w < 1 << 63 else None for w in want]


def test_exact_sums_of_large_entries(spark):
    top = (1 << 52) - 1
    fit = spark.createDataFrame([([top, -top],), ([top - 1, -top + 2],), ([7, -9],)], "x array<long>")
    assert whitening._exact_sums(fit, 2) == (3, [2 * top - 1 + 7, -2 * top + 2 - 9])


def test_whitening_query(spark):
    out = queries.op12_whitening(spark, SF)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 16 * spark.read.parquet(f"{SF}/embeddings.parquet").count()


# HTML.

BLOCK_TAG = re.compile(r"</?(?:%s)\b[^>]*>" % "|".join(sorted(htmltext.BLOCKS, key=len, reverse=True)), re.I)


def article(pieces):
    """The text of a generated page's article pieces, by plain replacement."""
    text = "\0".join(p for p, inside in pieces if inside)
    text = re.sub(r"<[^>]*>", "", BLOCK_TAG.sub("\0", text))
    return " ".join(t for t in (" ".join(html.unescape(b).split()) for b in text.split("\0")) if t)


def test_held_out_pages():
    model, right, share = htmltext.trained(), 0, []
    for k in range(300):
        pieces = htmltext.labelled(99 * 1_000_003 + k)
        got, want = htmltext.extract("".join(p for p, _ in pieces), model), article(pieces)
        a, b = Counter(got.split()), Counter(want.split())
        right += got == want
        share.append(2 * (a & b).total() / max(1, a.total() + b.total()))
    assert right > 240 and np.mean(share) > 0.97


def test_region_by_brute_force():
    r = random.Random(3)
    for _ in range(400):
        values = [r.randint(-4, 4) for _ in range(r.randint(0, 12))]
        a, b = htmltext.best_region(values)
        sums = [sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
        assert sum(values[a:b]) == max([0, *sums])
        assert (a == b) == (max([0, *sums]) == 0)


PAGE = (
    "<html><head><title>T</title><script>if (a < b) '</p>'</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>"
    "<article><h1>A  title &amp; more</h1><p>First <b>para</b>graph of the\n\tarticle, with some <a href='x>y'>linked words</a> in it&nbsp;&#33;</p><div class='ad-box'>Buy now cheap things here</div>"
    "<!-- <p>hidden</p> --><p>Second &lt;paragraph&gt; 1 < 2 of it.<br>Line</p><style>p{}</style><p>End.</p></article>"
    "<section class='comments'><h2>Comments</h2><p>I liked this text very much, thank you all.</p></section><aside class=sidebar><p>About us and others</p></aside>"
    "<form><label>Mail</label><input><button>Send</button></form><div id=cookie-notice>We use cookies on this site.</div><footer>&copy; us</footer>"
)


def test_one_page():
    want = "A title & more First paragraph of the article, with some linked words in it ! Second <paragraph> 1 < 2 of it. Line End."
    assert htmltext.extract(PAGE, htmltext.trained()) == want
    assert htmltext.extract(PAGE.split("First")[0] + "First words of a page that is cut &am", htmltext.trained()) == "A title & more First words of a page that is cut &am"


@pytest.mark.parametrize("part", ["<", "<a x=\"", "<a ", "<b>x ", "<div><p>word", "<!--", "<script>", "<p><b>word</i>", "&amp", "= ", "<td>x", "<!", "</p>"])
def test_linear_time(part):
    assert isinstance(htmltext.extract(part * 100_000, htmltext.trained()), str)


def test_html_rows(spark):
    data = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, "u", PAGE), (4, "u", "plain words without a tag, and so one block of text"), (5, "u", "<p>" + "long text " * 100_000), (6, "u", "<nav>only <a>menu</a></nav>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in data], "page_id long, url string, html string, text string, n_chars int")
    out = htmltext.main_text(pages).collect()
    assert [(r.page_id, r.url) for r in out] == [(a, b) for a, b, _ in data]
    assert [r.text for r in out[:2]] == ["", ""] and out[7].text == ""
    assert out[2].text == out[3].text == out[4].text and out[2].text.startswith("A title")
    assert out[5].text == data[5][2] and out[6].n_chars == 999_999
    assert all(r.n_chars == len(r.text) for r in out)
    assert htmltext.main_text(pages.where("false")).count() == 0


def test_html_query(spark):
    out = queries.op13_html_text(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(out) == len(pages)
    for r in out:
        assert r.text == article([(pages[r.page_id].split("<article>")[1].split("</article>")[0], True)])
