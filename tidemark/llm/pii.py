"""Personal data by base patterns and a semi-Markov conditional random field.

The field scores whole candidate spans by their features; dynamic programming over entities of bounded length chooses
boundaries and kinds together. It is trained here on generated sentences. It adds what the patterns miss, such as two
numbers that a pattern takes for one; spans of the patterns stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: Longest entity, in tokens, and in digits unless it is an address.
LONGEST, MOST_DIGITS = 16, 19
#: Characters to a side in which white space ends a region, three times.
REACH = 80
#: Tokens before a span that may hint at its kind.
CUE_REACH = 4
#: Tokens that are looked at at once, and scores of spans that are kept.
WINDOW, KEPT_SCORES = 4096, 1 << 14

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # the first digit of a run decides for all
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """Whether the number is at most 255, however many zeros or digits it has."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``: each holds one at-sign and all that fits before it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` by start and kind, in code points."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(x) for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


# The field.

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\S\n]+|.|\n", re.S)
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_GROUPED = re.compile(r"[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -]?[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}")
_CALL = re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,4}){2,4}")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DATE = re.compile(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}")
_CUES = {"tel": 3, "phone": 3, "call": 3, "fax": 3, "mobile": 3, "card": 2, "visa": 2, "credit": 2, "ip": 1, "host": 1, "mail": 0, "email": 0}
N_FEATURES = 24
_SHAPE = str.maketrans("123456789", "0" * 9)


def _features(tokens: list[str], i: int, j: int) -> np.ndarray | None:
    """Of the whole span of tokens i to j - 1; None if it can't be an entity."""
    span = "".join(tokens[i:j])
    digits = "".join(_DIGITS.findall(span))
    mail = span.count("@") == 1
    if not mail and len(digits) < 4:
        return None
    before, after = tokens[i - 1] if i else " ", tokens[j] if j < len(tokens) else " "
    letters = any(c.isalpha() for c in span)
    quad = bool(_QUAD.fullmatch(span))
    cue = next((_CUES[w] for t in tokens[max(0, i - CUE_REACH) : i][::-1] if (w := t.lower()) in _CUES), -1)
    n = len(digits)
    f = [
        1.0,
        bool(_MAIL.fullmatch(span)),
        quad,
        quad and all(int(x) <= 255 for x in span.split(".")),
        not letters and 14 <= n <= 19 and luhn(digits),
        not letters and n == 16,
        bool(_GROUPED.fullmatch(span)),
        span.isdigit(),
        bool(_CALL.fullmatch(span)),
        span[0] == "+" and not letters,
        span[0] == "+" and 10 <= n <= 15,
        span[0] == "(",
        10 <= n <= 13,
        n < 10,
        n > 19,
        letters and not mail,
        before.isalnum() or before[-1] in "+@._-=/",
        after.isalnum() or after[0] in "@_=/",
        bool(_DATE.fullmatch(span)),
        cue == 0,
        cue == 1,
        cue == 2,
        cue == 3,
        "." in span and not mail and not quad,
    ]
    return np.array(f, float)


def _ends(tokens: list[str], i: int) -> Iterator[int]:
    """Ends of the spans from i that may be entities.

    They begin at a letter, digit, plus sign or bracket and end at a letter or digit; without an at-sign they have no
    letters and no more digits than any number of the four kinds.
    """
    a = tokens[i]
    if not (a[0].isalnum() or a[0] in "+("):
        return
    digits, letters, mail = 0, False, False
    for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
        z = tokens[j - 1]
        if z == "\n":
            return
        mail |= z == "@"
        digits += len(z) if z.isascii() and z.isdigit() else 0
        letters |= z[0].isalpha()
        if z[-1].isalnum() and (mail or not (letters or digits > MOST_DIGITS)):
            yield j


def _candidates(tokens: list[str]) -> list[tuple[int, int, np.ndarray]]:
    """All spans that may be entities, with their features."""
    return [(i, j, f) for i in range(len(tokens)) for j in _ends(tokens, i) if (f := _features(tokens, i, j)) is not None]


def _lse(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _gradient(n: int, cands: list[tuple[int, int, np.ndarray]], gold: dict[tuple[int, int], int], w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the log-likelihood of one sentence of n tokens, by the weights and the transitions."""
    k = OUTSIDE + 1
    score = [w @ f for _, _, f in cands]
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (i, j, _) in enumerate(cands):
        ending[j].append(c)
        starting[i].append(c)
    alpha, beta = np.full((n + 1, k), -1e9), np.full((n + 1, k), -1e9)
    alpha[0, OUTSIDE], beta[n] = 0, 0
    for j in range(1, n + 1):
        alpha[j, OUTSIDE] = _lse(alpha[j - 1] + t[:, OUTSIDE])
        if ending[j]:
            alpha[j, :OUTSIDE] = _lse(np.array([_lse(alpha[cands[c][0]][:, None] + t[:, :OUTSIDE], 0) + score[c] for c in ending[j]]), 0)
    for i in range(n - 1, -1, -1):
        ways = [t[:, OUTSIDE] + beta[i + 1, OUTSIDE]]
        ways += [_lse(t[:, :OUTSIDE] + (score[c] + beta[cands[c][1], :OUTSIDE])[None, :], 1) for c in starting[i]]
        beta[i] = _lse(np.array(ways), 0)
    z = _lse(alpha[n])
    gw, gt, like = np.zeros_like(w), np.zeros_like(t), -float(z)
    for c, (i, j, f) in enumerate(cands):
        joint = np.exp(alpha[i][:, None] + t[:, :OUTSIDE] + (score[c] + beta[j, :OUTSIDE])[None, :] - z)
        gt[:, :OUTSIDE] -= joint
        gw -= joint.sum(0)[:, None] * f[None, :]
    for i in range(n):
        gt[:, OUTSIDE] -= np.exp(alpha[i] + t[:, OUTSIDE] + beta[i + 1, OUTSIDE] - z)
    at, last = 0, OUTSIDE
    by_span = {(i, j): c for c, (i, j, _) in enumerate(cands)}
    ends = {i: (j, y) for (i, j), y in gold.items() if (i, j) in by_span}
    while at < n:
        j, y = ends.get(at, (at + 1, OUTSIDE))
        gt[last, y] += 1
        like += t[last, y]
        if y != OUTSIDE:
            c = by_span[at, j]
            gw[y] += cands[c][2]
            like += score[c][y]
        at, last = j, y
    return gw, gt, like


def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated sentence and its entities, as start, end and kind."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = r.choice("3456") + digits(r.choice((14, 14, 14, 13, 15)))
        full = next(body + c for c in "0123456789" if luhn(body + c))
        return r.choice((full, full, " ".join(full[i : i + 4] for i in range(0, len(full), 4)) if len(full) == 16 else full, "-".join(full[i : i + 4] for i in range(0, len(full), 4)) if len(full) == 16 else full))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+{r.randint(20, 99)} {digits(2)} {digits(4)} {c}", f"+{r.randint(20, 99)}{digits(10)}"))

    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    mail = lambda: f"{word()}{r.choice(('', '.', '_'))}{r.choice(('', digits(2)))}@{word()}{r.choice(('', digits(1)))}.{r.choice(('example.com', 'com', 'org'))}"
    noise = (
        lambda: digits(r.randint(1, 13)),
        lambda: f"{digits(1)}.{digits(1)}.",
        lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}",
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
        lambda: "password=" + "".join(r.choice("0123456789abcdef") for _ in range(18)),
        lambda: 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"',
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda: f"{digits(3)}.{r.randint(256, 999)}.{digits(2)}.{digits(1)}",
        lambda: f"{word()}@{word()}",
        lambda: digits(r.choice((16, 17, 20, 24))),
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}",
    )
    text, gold = "", []
    for _ in range(r.randint(1, 4)):
        text += " ".join(word() for _ in range(r.randint(0, 3)))
        if r.random() < 0.3:
            text += " " + r.choice(("call", "tel", "card", "ip", "mail", "phone"))
        text += " " if text and not text.endswith(" ") else ""
        if r.random() < 0.7:
            y = r.randrange(4)
            s = (mail, ip, card, phone)[y]()
            gold.append((len(text), len(text) + len(s), y))
        else:
            s = r.choice(noise)()
        text += s + r.choice((" ", " ", " ", ", ", ". "))
    return text.strip(), gold


@cache
def trained(sentences: int = 240, rounds: int = 6, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights by kind and feature, and transitions, by gradient ascent on generated sentences."""
    r = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, gold = _sentence(r)
        ms = list(_TOKEN.finditer(text))
        first, last = {m.start(): k for k, m in enumerate(ms)}, {m.end(): k + 1 for k, m in enumerate(ms)}
        tokens = [m[0] for m in ms]
        data.append((len(tokens), _candidates(tokens), {(first[a], last[b]): y for a, b, y in gold if a in first and b in last}))
    w, t = np.zeros((OUTSIDE, N_FEATURES)), np.zeros((OUTSIDE + 1, OUTSIDE + 1))
    w[:, 0] = -2
    hw, ht = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    for _ in range(rounds):
        for n, cands, gold in data:
            gw, gt, _ = _gradient(n, cands, gold, w, t)
            gw, gt = gw - 1e-3 * w, gt - 1e-3 * t
            hw, ht = hw + gw * gw, ht + gt * gt
            w, t = w + 0.5 * gw / np.sqrt(hw), t + 0.5 * gt / np.sqrt(ht)
    return w, t


class _Scores:
    """Scores of spans. Those without letters depend on their shape and little else, so they are kept."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.kept = weights, {}

    def __call__(self, tokens: list[str], i: int, j: int) -> list[float] | None:
        span = "".join(tokens[i:j])
        if not (span.isascii() and not any(t.isalpha() for t in tokens[i:j])):
            return self._new(tokens, i, j)
        before, after = tokens[i - 1] if i else " ", tokens[j] if j < len(tokens) else " "
        cues = tuple(_CUES.get(t.lower(), -1) for t in tokens[max(0, i - CUE_REACH) : i])
        digits = "".join(_DIGITS.findall(span))
        quad = "." in span and bool(_QUAD.fullmatch(span)) and all(int(x) <= 255 for x in span.split("."))
        key = (span.translate(_SHAPE), quad, 14 <= len(digits) <= 19 and luhn(digits), before.isalnum() or before[-1] in "+@._-=/", after.isalnum() or after[0] in "@_=/", cues)
        if key not in self.kept:
            if len(self.kept) >= KEPT_SCORES:
                self.kept.clear()
            self.kept[key] = self._new(tokens, i, j)
        return self.kept[key]

    def _new(self, tokens: list[str], i: int, j: int) -> list[float] | None:
        f = _features(tokens, i, j)
        return None if f is None else (self.weights @ f).tolist()


def _best(n: int, window: Callable[[int, int], list[str]], scores: _Scores, t: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's entities among n tokens, as first token, end and kind.

    ``window(a, b)`` gives the tokens a to b - 1. Only the last LONGEST + 1 columns of the table are kept, and a byte for
    each token and label to go back by.
    """
    k, low = OUTSIDE + 1, -1e18
    moves = [[float(x) for x in row] for row in t]
    back = bytearray((n + 1) * k)
    ahead = [[low] * k for _ in range(LONGEST + 1)]  # of the tokens from i on, in a ring
    ahead[0][OUTSIDE] = 0.0
    for base in range(0, n, WINDOW):
        first = max(0, base - CUE_REACH)
        tokens = window(first, min(n, base + WINDOW + LONGEST + 1))
        for i in range(base, min(n, base + WINDOW)):
            here = ahead[i % (LONGEST + 1)]
            step = ahead[(i + 1) % (LONGEST + 1)]
            top = max(range(k), key=lambda y: here[y] + moves[y][OUTSIDE])  # noqa: B023
            step[OUTSIDE] = here[top] + moves[top][OUTSIDE]
            back[(i + 1) * k + OUTSIDE] = top
            into = None
            for j in _ends(tokens, i - first):
                score = scores(tokens, i - first, j)
                if score is None:
                    continue
                if into is None:
                    from_ = [max(range(k), key=lambda x: here[x] + moves[x][y]) for y in range(OUTSIDE)]  # noqa: B023
                    into = [here[x] + moves[x][y] for y, x in enumerate(from_)]
                length = j - (i - first)
                there = ahead[(i + length) % (LONGEST + 1)]
                for y in range(OUTSIDE):
                    if into[y] + score[y] > there[y]:
                        there[y] = into[y] + score[y]
                        back[(i + length) * k + y] = (length - 1) * k + from_[y]
            ahead[i % (LONGEST + 1)] = [low] * k
    last = ahead[n % (LONGEST + 1)]
    out, j, y = [], n, max(range(k), key=lambda y: last[y])
    while j > 0:
        if y == OUTSIDE:
            j, y = j - 1, back[j * k + OUTSIDE]
        else:
            length, before = divmod(back[j * k + y], k)
            out.append((j - length - 1, j, y))
            j, y = j - length - 1, before
    return out[::-1]


def _decode(tokens: list[str], w: np.ndarray, t: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's entities, as first token, end and kind."""
    return _best(len(tokens), lambda a, b: tokens[a:b], _Scores(w), t)


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Where digits or at-signs are, with context, each extended to white space; regions that touch are one."""
    a = b = -1
    for m in _SEED.finditer(text):
        if m.start() < b:
            continue
        start, end = m.start(), m.end()
        for _ in range(3):
            near, upto = max(0, start - REACH), max(start - 1, 0)
            start = max(text.rfind(" ", near, upto), text.rfind("\n", near, upto), near)
            right = [x for x in (text.find(" ", end + 1, end + REACH + 1), text.find("\n", end + 1, end + REACH + 1)) if x >= 0]
            end = min([*right, len(text), end + REACH])
        if start <= b:
            b = max(b, end)
        else:
            if b >= 0:
                yield a, b
            a, b = start, end
    if b >= 0:
        yield a, b


def spans(text: str, scores: _Scores, moves: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans, as ``(start, kind, end)``."""
    if not _SEED.search(text):
        return [], []
    base = base_spans(text)
    out = list(base)
    taken = sorted((a, b) for a, _, b in base)
    starts, furthest = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for a, b in _regions(text):
        ends = array("q", [a])
        ends.extend(m.end() for m in _TOKEN.finditer(text, a, b))
        window = lambda x, y: [text[p:q] for p, q in pairwise(ends[x : y + 1])]  # noqa: B023, E731
        for i, j, y in _best(len(ends) - 1, window, scores, moves):
            s, e = ends[i], ends[j]
            before = bisect_left(starts, e)  # base spans that begin before the end
            if not before or furthest[before - 1] <= s:
                out.append((s, y, e))
    return base, sorted(out)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans``, ``n_spans``.

    Null and empty texts have no spans. Repeated rows get the same result, null ids are kept, other columns are ignored,
    an empty table gives no rows. Texts are searched whole; the field sees the surroundings of each digit or at-sign.
    """
    weights, moves = trained()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(weights)
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digest, joined, total = [], [], []
            for text in batch.column(1):
                base, found = spans(text.as_py() or "", scores, moves)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(found))
                total.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(joined, pa.string()), pa.array(total, pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
