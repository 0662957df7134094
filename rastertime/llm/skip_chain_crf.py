"""Personal data by patterns and a skip-chain conditional random field (Sutton and McCallum, 2004).

The patterns give base spans. Each base span is an observed node of its document's graph, and so is not each other token
with a digit or an @, over whole texts: its label is unknown. Neighbouring nodes share chain potentials. Nodes that are
similar, however far apart, share skip potentials: equal but for letter case (from 5 characters on), at an edit distance
of one (from 8 on), or with the same last seven digits. Loopy message passing runs until the messages settle, and nodes whose belief in a kind is high
become added spans. Base spans always stay.

Node and chain weights maximise the pseudo-likelihood of the base labels over all documents; nodes that are similar to a
base span are left out of these counts, as their label is what is asked for. The skip weight is the smoothed log odds
that similar base spans are of one kind. Tasks sum nodes by their description, of which there is a bounded number.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Belief from which an unobserved token is added.
CERTAIN = 0.9
#: Messages stop once none moves by more than this, or after so many rounds.
TOLERANCE, ROUNDS = 1e-4, 200
#: Digits up to which neighbouring tokens of a kind are one span.
MOST_DIGITS = {"card": 19, "phone": 15}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that starts within a run of digits also starts at the run's first digit, so runs are entered there only
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ matches from the left, in linear time: from each @ back."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            low = m.end()
        at = text.find("@", max(low, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind, then start; ends are exclusive, in code points."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        d = _DIGITS.sub("", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


#: Characters from which a token links to its repeats and, at an edit distance of one, to other tokens; and last digits
#: that tokens must share. Shorter ones agree by chance (years, versions, list numbers). Longer ones have no limit.
LONG, EDITED, TAIL = 5, 8, 7
_BASE, _PRIME = 1_000_003, (1 << 61) - 1

#: Sizes of the parts of a code: @, leading +, bracket, hyphen, letters, Luhn, dots, digits.
_FIELDS = (2, 2, 2, 2, 2, 2, 5, 7)
CODES = int(np.prod(_FIELDS))


@dataclass
class Graph:
    """The nodes of one document, in order."""

    spans: list[tuple[int, int]]  # a base span, or a token without marks at either side
    codes: np.ndarray  # what the node looks like
    seen: np.ndarray  # label of a base span, 0 of other tokens
    chain: np.ndarray  # pairs of neighbours with blanks alone between them
    skip: np.ndarray  # pairs of similar nodes


def _code(core: str, digits: str) -> int:
    n = len(digits)
    bucket = (n > 0) + (n > 3) + (n > 6) + (n > 9) + (n > 15) + (n > 19)
    parts = ("@" in core, core[0] == "+", "(" in core or ")" in core, "-" in core, any(c.isalpha() for c in core), 16 <= n <= 19 and luhn(digits), min(4, core.count(".")), bucket)
    code = 0
    for size, p in zip(_FIELDS, parts):
        code = code * size + int(p)
    return code


def _indicators() -> np.ndarray:
    """A row of 0 and 1 for each code: one column per value of each field, and a constant."""
    rest, cols = np.arange(CODES), [np.ones(CODES)]
    for size in reversed(_FIELDS):
        cols += [(rest % size == v).astype(float) for v in range(size)]
        rest = rest // size
    return np.stack(cols, axis=1)


def whole_hash(core: str) -> int:
    h = 0
    for ch in core:
        h = (h * _BASE + ord(ch)) % _PRIME
    return h


def shortened(core: str) -> set[int]:
    """The ``whole_hash`` of the token without each one of its characters, in linear time."""
    ahead, out = [0], set()
    for ch in core[:-1]:
        ahead.append((ahead[-1] * _BASE + ord(ch)) % _PRIME)
    after, power = 0, 1
    for k in range(len(core) - 1, -1, -1):
        out.add((ahead[k] * power + after) % _PRIME)
        after = (ord(core[k]) * power + after) % _PRIME
        power = power * _BASE % _PRIME
    return out


def similar(cores: list[str], digits: list[str]) -> set[tuple[int, int]]:
    """Pairs of places of similar nodes. Of nodes that share a reason, each meets the first and the one before it, so pairs
    are linear in the text and still join all of them."""
    out: set[tuple[int, int]] = set()
    ends: dict[object, tuple[int, int]] = {}  # reason: first and latest place

    def meet(reason: object, i: int) -> None:
        first, latest = ends.get(reason, (i, i))
        out.update((x, i) for x in {first, latest} if x != i)
        ends[reason] = (first, i)

    for i, (core, d) in enumerate(zip(cores, digits)):
        if len(core) >= LONG:
            meet(core, i)
        if len(d) >= TAIL:
            meet((1, d[-TAIL:]), i)
    by: dict[str, int] = {}
    for i, core in enumerate(cores):
        if len(core) >= EDITED:
            by.setdefault(core, i)
    if len(by) > 1:  # different cores at distance one agree once a character is left out of one or both
        for core, i in by.items():
            meet((2, whole_hash(core)), i)
            for less in shortened(core):
                meet((2, less), i)
    return out


def graph(text: str, base: list[tuple[int, int, int]]) -> Graph:
    nodes = [(a, b, k + 1) for k, a, b in base]
    covered, j = sorted((a, b) for _, a, b in base), 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and not (text[a].isalnum() or text[a] in "+(@"):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if a == b:
            continue
        while j < len(covered) and covered[j][1] <= a:
            j += 1
        # base spans of different kinds may overlap, so one that ends further on may begin earlier
        if not any(x < b and y > a for x, y in itertools.takewhile(lambda c: c[0] < b, itertools.islice(covered, j, None))):
            nodes.append((a, b, 0))
    nodes.sort()
    cores = [text[a:b].lower() for a, b, _ in nodes]
    digits = [_DIGITS.sub("", c) for c in cores]
    beside = [(i - 1, i) for i in range(1, len(nodes)) if nodes[i - 1][1] <= nodes[i][0] and not text[nodes[i - 1][1] : nodes[i][0]].strip(" ")]
    two = lambda x: np.array(sorted(x), np.int64).reshape(-1, 2)
    codes = np.array([_code(c, d) for c, d in zip(cores, digits)], np.int64)
    return Graph([(a, b) for a, b, _ in nodes], codes, np.array([k for *_, k in nodes], np.int64), two(beside), two(similar(cores, digits)))


def together(graphs: list[Graph]) -> tuple[Graph, np.ndarray]:
    """Several graphs as one without edges between them, and the number of the graph of each node."""
    sizes = [len(g.spans) for g in graphs]
    start = np.cumsum([0, *sizes[:-1]])
    cat = lambda xs, like: np.concatenate(xs) if xs else np.zeros(like, np.int64)
    whole = Graph(
        [s for g in graphs for s in g.spans], cat([g.codes for g in graphs], 0), cat([g.seen for g in graphs], 0),
        cat([g.chain + k for g, k in zip(graphs, start)], (0, 2)), cat([g.skip + k for g, k in zip(graphs, start)], (0, 2)),
    )
    return whole, np.repeat(np.arange(len(graphs)), sizes)


@dataclass
class SkipChain:
    node: np.ndarray  # by code and label
    chain: np.ndarray  # by label and next label
    skip: float

    def beliefs(self, g: Graph, of: np.ndarray | None = None) -> np.ndarray:
        """Marginals of every node by parallel, damped sum-product messages over both kinds of edges.

        Each graph's messages stop once none of them moves by TOLERANCE, so a document's beliefs don't depend on those
        that are worked on with it; one that doesn't settle stops after ROUNDS.
        """
        k = len(LABELS)
        of = np.zeros(len(g.spans), np.int64) if of is None else of
        phi = self.node[g.codes].astype(float)
        phi[g.seen > 0] = -30
        phi[g.seen > 0, g.seen[g.seen > 0]] = 0
        c, s = len(g.chain), len(g.skip)
        src = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.skip[:, 0], g.skip[:, 1]])
        dst = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.skip[:, 1], g.skip[:, 0]])
        back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c]).astype(np.int64)
        kind = np.concatenate([np.zeros(c), np.ones(c), np.full(2 * s, 2)]).astype(np.int64)
        pots = np.exp(np.stack([self.chain, self.chain.T, self.skip * np.eye(k)]))
        msg, belief = np.zeros((len(src), k)), phi.copy()
        live = np.arange(len(src))
        for _ in range(ROUNDS):
            if not len(live):
                break
            x = belief[src[live]] - msg[back[live]]
            x = np.exp(x - x.max(axis=1, keepdims=True))
            new = np.empty_like(x)
            for e in range(3):
                mine = kind[live] == e
                new[mine] = x[mine] @ pots[e]
            new = np.log(new)
            new = 0.5 * msg[live] + 0.5 * (new - new.max(axis=1, keepdims=True))
            moved = np.abs(new - msg[live]).max(axis=1)
            np.add.at(belief, dst[live], new - msg[live])
            msg[live] = new
            most = np.zeros(int(of.max()) + 1)
            np.maximum.at(most, of[src[live]], moved)
            live = live[most[of[src[live]]] >= TOLERANCE]
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """For each text, spans of tokens that no base span covers and whose belief in a kind is CERTAIN.

        Neighbouring tokens of a kind are one span. A text in which every node is a base span, or none can be one of
        the kinds, has none without any messages: beliefs of nodes without edges are those of their look alone.
        """
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        graphs = [graph(t, b) for t, b in zip(texts, bases)]
        open_ = [i for i, g in enumerate(graphs) if (g.seen == 0).any()]
        for at in range(0, len(open_), 256):
            part = open_[at : at + 256]
            whole, of = together([graphs[i] for i in part])
            p = self.beliefs(whole, of)
            start = 0
            for i in part:
                g = graphs[i]
                out[i] = self._spans(texts[i], g, p[start : start + len(g.spans)])
                start += len(g.spans)
        return out

    def _spans(self, text: str, g: Graph, p: np.ndarray) -> list[tuple[int, int, int]]:
        kind = p.argmax(axis=1)
        sure = np.flatnonzero((kind > 0) & (g.seen == 0) & (p.max(axis=1) >= CERTAIN))
        joined = {(int(a), int(b)) for a, b in g.chain} if len(sure) else set()
        out: list[list[int]] = []
        for i in sure.tolist():
            k, (a, b) = int(kind[i]) - 1, g.spans[i]
            fits = out and sum(c.isdecimal() for c in text[out[-1][1] : b]) <= MOST_DIGITS.get(KINDS[k], 0)
            if fits and out[-1][0] == k and out[-1][3] == i - 1 and (i - 1, i) in joined:
                out[-1][2:] = [b, i]
            else:
                out.append([k, a, b, i])
        return [(k, a, b) for k, a, b, _ in out]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def train(docs: DataFrame, text: str = "text", steps: int = 300) -> SkipChain:
    """Pseudo-likelihood over all documents. Only counts by (code, label, labels beside) come to the driver.

    Null and empty texts count nothing, repeated rows count each. Without any span, and for an empty table, all weights stay
    zero and the skip weight has its least value. Other columns are not read; memory is in proportion to the longest text.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for x in pdf[text]:
                if not isinstance(x, str) or not x:
                    continue
                t = graph(x, base_spans(x))
                if not t.spans:
                    continue
                left, right = np.full(len(t.spans), -1), np.full(len(t.spans), -1)
                left[t.chain[:, 1]] = t.seen[t.chain[:, 0]]
                right[t.chain[:, 0]] = t.seen[t.chain[:, 1]]
                near = t.seen[t.skip]
                asked = np.zeros(len(t.spans), bool)
                asked[t.skip[near[:, 1] > 0, 0]] = asked[t.skip[near[:, 0] > 0, 1]] = True
                known = np.flatnonzero((t.seen > 0) | ~asked)
                total.update(zip(t.codes[known].tolist(), t.seen[known].tolist(), left[known].tolist(), right[known].tolist()))
                hit = near.all(axis=1)
                total[-1, 0, 0, 0] += int((hit & (near[:, 0] != near[:, 1])).sum())
                total[-1, 1, 0, 0] += int((hit & (near[:, 0] == near[:, 1])).sum())
        yield pd.DataFrame([(*k, v) for k, v in total.items()], columns=["code", "label", "before", "after", "n"], dtype="int64")

    got = docs.select(text).mapInPandas(count, "code long, label long, before long, after long, n long").groupBy("code", "label", "before", "after").agg(F.sum("n").alias("n")).collect()
    agree = {r.label: r.n for r in got if r.code < 0}
    rows = np.array([tuple(r) for r in got if r.code >= 0], np.int64).reshape(-1, 5)
    look, k = _indicators(), len(LABELS)
    w, a = np.zeros((look.shape[1], k)), np.zeros((k, k))
    if len(rows):
        x, y, before, after, n = look[rows[:, 0]], rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4].astype(float)
        n /= n.sum()
        one = np.eye(k)
        b1, a1 = np.where(before[:, None] >= 0, one[before], 0), np.where(after[:, None] >= 0, one[after], 0)
        gw2, ga2 = np.zeros_like(w), np.zeros_like(a)
        for _ in range(steps):  # full-batch AdaGrad on the convex objective
            z = x @ w + b1 @ a + a1 @ a.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - one[y]) * n[:, None]
            gw, ga = x.T @ d + 1e-4 * w, b1.T @ d + (a1.T @ d).T + 1e-4 * a
            gw2 += gw**2
            ga2 += ga**2
            w -= 0.3 * gw / np.sqrt(gw2 + 1e-12)
            a -= 0.3 * ga / np.sqrt(ga2 + 1e-12)
    odds = np.log((agree.get(1, 0) + 1) / (agree.get(0, 0) + 1) * (k - 1))
    return SkipChain(look @ w, a, float(np.clip(odds, 2.0, 8.0)))


def find(docs: DataFrame, model: SkipChain, text: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone and base_sha256 of the base spans and spans, all spans, to every row.

    A null text counts as an empty one. Repeated rows get equal results, empty tables stay empty, and input columns of
    those names are replaced. Work and memory are linear in a text's length.
    """
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    docs = docs.drop(*names)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a row per code: fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            texts = [x if isinstance(x, str) else "" for x in pdf[text]]
            bases = [base_spans(x) for x in texts]
            for base, more in zip(bases, held.value.added(texts, bases)):
                counts = Counter(k for k, _, _ in base)
                out.append((*(counts[i] for i in range(len(KINDS))), hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + more)))
            made = pd.DataFrame(out, columns=names, index=pdf.index)
            yield pd.concat([pdf, made.astype({n: "int64" for n in names[:4]})], axis=1)

    return docs.mapInPandas(run, docs.selectExpr("*", *[f"0L AS {n}" for n in names[:4]], "'' AS base_sha256", "'' AS spans").schema)
