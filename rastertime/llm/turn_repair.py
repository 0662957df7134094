"""Repairs the order of roles in conversations: the cheapest edits that make role initials match (s?(ua)+)?.

Edits of a row: Keep (0), Rerole to user or assistant (3), Delete (4; blank and repeated rows must go); a truncated row
that stays adds 3. Insert (3) puts an empty user or assistant row anywhere. The grammar has four states: nothing yet, after
a system row, after a user row, after an assistant row. A forward Viterbi pass carries the least (cost, audit) to each
state, the audit being the edits' initials; after each row the layer is closed by inserts, of which two lead to any state.
Audits of one cost at one state spend their cost on the same number of rows, so none begins another, and the least audit
of a prefix stays least whatever follows.

Rows become codes of one character, sorted over all conversations by ranges. A range gives for each of its conversations
the least (cost, audit) from a state to a state; the pieces of a conversation that spans ranges are composed in order, so
its rows are never in one task. Texts are shuffled once, when the edits are carried out: a conversation streams through a
task in order, holding its audit and no more than a batch of its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertime.llm.base import attach, materialise, partitions, release

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the grammar, and those that a conversation may end in.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
END = (NOTHING, ASSISTANT)
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
#: Rows after which the audits' common beginning is set aside.
FLUSH = 256


def _later(path, cost: int, edit: str):
    return None if path is None else (path[0] + cost, path[1] + edit)


def _least(*paths):
    return min((p for p in paths if p is not None), default=None)


def closed(layer: list) -> list:
    """A layer with what inserts reach from it."""
    n, s, u, a = layer
    u = _least(u, _later(_least(n, s, a), INSERT, "I"))
    return [n, s, u, _least(a, _later(u, INSERT, "I"))]


def step(layer: list, code: str) -> list:
    """The layer after a row: x must go; s, u, a, o are initials (o any other), in upper case for truncated rows."""
    n, s, u, a = layer
    out = [_later(p, DELETE, "D") for p in layer]
    if code != "x":
        initial, more = code.lower(), TRUNCATED * code.isupper()
        before_user = _least(n, s, a)
        if initial == "s":
            out[SYSTEM] = _least(out[SYSTEM], _later(n, KEEP + more, "K"))
        out[USER] = _least(out[USER], _later(before_user, REROLE + more, "R"), _later(before_user, KEEP + more, "K") if initial == "u" else None)
        out[ASSISTANT] = _least(out[ASSISTANT], _later(u, REROLE + more, "R"), _later(u, KEEP + more, "K") if initial == "a" else None)
    return closed(out)


def forward(codes: str, start: int = NOTHING) -> list:
    """Least (cost, audit) or None to each state after the rows, from a state before them."""
    layer, head = [None] * 4, []
    layer[start] = (0, "")
    layer = closed(layer)
    for i, code in enumerate(codes, 1):
        layer = step(layer, code)
        if i % FLUSH == 0:
            n = len(commonprefix([p[1] for p in layer if p is not None]))
            head.append(next(p for p in layer if p is not None)[1][:n])
            layer = [p and (p[0], p[1][n:]) for p in layer]
    done = "".join(head)
    return [p and (p[0], done + p[1]) for p in layer]


@lru_cache(maxsize=50_000)
def remembered(codes: str, start: int) -> list:
    return forward(codes, start)


def roles(audit: str, kept: Iterator[str]) -> Iterator[tuple[str, str | None]]:
    """(edit, role) of each edit of an audit, None where the role stays or the row goes; ``kept`` gives kept rows' roles."""
    before = ""
    for edit in audit:
        if edit == "D":
            yield edit, None
        elif edit == "K":
            before = next(kept)[:1]
            yield edit, None
        else:
            before = "a" if before == "u" else "u"
            yield edit, "user" if before == "u" else "assistant"


def _text_key(*more) -> list:
    """128 bits that name a row's role and text."""
    return [F.xxhash64(F.lit(seed), *more, "role", "text") for seed in (1, 2)]


def _plain(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text): the conversation as text, and a space for each null role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def coded(rows: DataFrame) -> DataFrame:
    """(part, at, key, turn, known, initial, code, fault) per row, ordered by ``at`` over all conversations."""
    ending = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    facts = rows.select("key", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), (ending == "").alias("blank"), (~F.right(ending, F.lit(1)).isin(".", "!", "?")).alias("open"), *[k.alias(c) for k, c in zip(_text_key("key"), ("h1", "h2"))], *[k.alias(c) for k, c in zip(_text_key(), ("k1", "k2"))])
    facts = materialise(facts)
    order = ["key", "turn", "k1", "k2"]
    placed = facts.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).drop("k1", "k2")
    placed = materialise(placed.withColumn("at", F.monotonically_increasing_id()))
    several = materialise(placed.where("NOT blank").groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    fault = F.when(F.col("blank"), "b").when(F.col("at") > F.col("first"), "d").when(F.col("open"), "t").otherwise("")
    out = attach(placed, several, ["h1", "h2"], "left").withColumn("fault", fault)
    code = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    out = materialise(out.select(F.shiftright("at", 33).cast("int").alias("part"), "at", "key", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("known"), "initial", code.alias("code"), "fault"))
    release(facts, placed, several)
    return out


PIECE = "key string, part int, start int, counts array<long>, ends array<string>, paths array<struct<cost: long, audit: string>>"


def pieces(rows: DataFrame) -> DataFrame:
    """Per range of ``coded`` rows and conversation: counts, what its neighbours need to know, and paths from each state.

    Only the first conversation of a range can have begun earlier, and has a row for every state before it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seen = None, None  # rows of the last conversation; the range whose first conversation is done
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cut = cuts(pdf)
            held = pdf.iloc[cut[-1] :]
            made, seen = segments(pdf, cut, seen)
            yield made
        if held is not None:
            yield segments(held, [0, len(held)], seen)[0]

    def cuts(pdf: pd.DataFrame) -> list[int]:
        key, part = pdf["key"].fillna("\0").to_numpy(), pdf["part"].to_numpy()
        return [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist()]

    def segments(pdf: pd.DataFrame, cut: list[int], seen):
        out = []
        keys, parts, turns, known = pdf["key"].tolist(), pdf["part"].tolist(), pdf["turn"].tolist(), pdf["known"].tolist()
        initials, codes, faults = "".join(pdf["initial"]), "".join(pdf["code"]), pdf["fault"].tolist()
        for a, b in zip(cut, cut[1:]):
            t = sorted({x for x, k in zip(turns[a:b], known[a:b]) if k})
            legal = sum(initials.count(pair, a, b) for pair in ("su", "ua", "au"))
            counts = [len(t), *((t[0], t[-1]) if t else (0, 0)), *(faults[a:b].count(f) for f in "bdt"), b - a - 1 - legal]
            for start in range(4) if parts[a] != seen else [NOTHING]:
                paths = (remembered if b - a <= 64 else forward)(codes[a:b], start)
                out.append((keys[a], parts[a], start, counts, [initials[a], initials[b - 1]], [p and {"cost": p[0], "audit": p[1]} for p in paths]))
            seen = parts[a]
        return pd.DataFrame(out, columns=["key", "part", "start", "counts", "ends", "paths"]).astype({"part": "int32", "start": "int32"}), seen

    dealt = rows.repartitionById(partitions(rows.sparkSession), F.col("part")).sortWithinPartitions("at")
    return dealt.mapInPandas(run, PIECE)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of ``rows``, as a table to release.

    ``rows``: conv_id, turn (a long, or casts to one), role, text; other columns, whatever their names, are not read. Rows
    come by turn, null turns first, those of one turn by a hash of role and text, so repeated rows are neighbours. A null
    role or text counts as a space. Rows with a null conv_id are one conversation. A role without s, u or a as its initial can't be
    kept, an empty one neither. gaps: turns missing between the least and the largest; illegal: neighbours whose
    initials aren't su, ua or au. Among the cheapest edits the ASCII-least audit is chosen. An empty table gives no row;
    texts of any length are read, and memory is in proportion to the longest and to the longest audit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None  # [key, counts, initial of the last row, layer, part that the layer is before, layer after that part]
        for pdf in batches:
            out = []
            for key, part, start, counts, ends, paths in zip(*(pdf[c].tolist() for c in ("key", "part", "start", "counts", "ends", "paths"))):
                if now is None or now[0] != key:
                    out += finished(now)
                    now = [key, None, "", None, None, [(0, ""), None, None, None]]
                if part != now[4]:
                    now[1] = joined(now[1], [int(x) for x in counts], now[2] + ends[0])
                    now[2:5] = ends[1], now[5], part
                    now[5] = [None] * 4
                before = now[3][start]
                if before is not None:
                    now[5] = [_least(p, _later(before, int(q["cost"]), q["audit"]) if q is not None else None) for p, q in zip(now[5], paths)]
            yield table(out)
        yield table(finished(now))

    def joined(a: list[int] | None, b: list[int], meet: str) -> list[int]:
        if a is None:
            return b
        known = [x for x in (a, b) if x[0]] or [a]
        same = int(len(known) == 2 and a[2] == b[1])
        return [a[0] + b[0] - same, known[0][1], known[-1][2], *(x + y for x, y in zip(a[3:6], b[3:6])), a[6] + b[6] + (meet not in ("su", "ua", "au"))]

    def finished(now) -> list[tuple]:
        if now is None:
            return []
        n, low, high, *faults, illegal = now[1]
        cost, audit = _least(*(now[5][state] for state in END))
        return [(now[0], high - low + 1 - n if n else 0, *faults, illegal, cost, audit)]

    def table(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["conv_id", *COUNTS, "audit"]).astype({c: "int64" for c in COUNTS})

    codes = coded(_plain(rows))
    all_pieces = materialise(pieces(codes))
    in_order = all_pieces.repartition("key").sortWithinPartitions("key", "part", "start")
    found = in_order.mapInPandas(run, "conv_id string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")
    out = materialise(found.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType)))
    release(codes, all_pieces)
    return out


def _in_order(rows: DataFrame, report: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one task."""
    plain = _plain(rows)
    texts = plain.select("key", F.lit(1).alias("kind"), "turn", *[k.alias(c) for k, c in zip(_text_key(), ("k1", "k2"))], "role", "text")
    none = F.lit(None).cast("long")
    heads = report.select(F.col("conv_id").cast("string").alias("key"), F.lit(0).alias("kind"), none.alias("turn"), none.alias("k1"), none.alias("k2"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return heads.unionByName(texts).repartition("key").sortWithinPartitions("key", "kind", "turn", "k1", "k2").select("key", "kind", "role", "text")


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Batches of (key, edit, role, text), and (key, None, None, None) at the end of each conversation."""
    key, edits, kept = None, None, []

    def until_row(out: list) -> str | None:
        for edit, role in edits:
            if edit != "I":
                return edit, role
            out.append((key, edit, role, ""))
        return None

    for pdf in batches:
        out = []
        for k, kind, role, text in zip(*(pdf[c].tolist() for c in ("key", "kind", "role", "text"))):
            if kind == 0:
                if edits is not None:
                    until_row(out)
                    out.append((key, None, None, None))
                key, kept = k, []
                edits = roles(text, iter(kept.pop, None))
                continue
            kept[:] = [role]
            edit, new = until_row(out)
            if edit != "D":
                out.append((key, edit, new or role, text))
        yield out
    if edits is not None:
        out = []
        until_row(out)
        yield [*out, (key, None, None, None)]


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the rows of every conversation after the edits of ``report``, from position 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for found in _edited(batches):
            out = []
            for key, edit, role, text in found:
                if edit is None:
                    at = 0
                    continue
                out.append((key, at, edit, role, text))
                at += 1
            yield pd.DataFrame(out, columns=["conv_id", "position", "edit", "role", "text"]).astype({"position": "int64"})

    out = _in_order(rows, report).mapInPandas(run, "conv_id string, position long, edit string, role string, text string")
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def digests(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of each repaired conversation's role:text, joined by newlines.

    A hash of one text can't be split, so a conversation passes through one task; it streams, and is never held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, between = hashlib.sha256(), ""
        for found in _edited(batches):
            out = []
            for key, edit, role, text in found:
                if edit is None:
                    out.append((key, h.hexdigest()))
                    h, between = hashlib.sha256(), ""
                else:
                    h.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                    between = "\n"
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])

    out = _in_order(rows, report).mapInPandas(run, "conv_id string, repaired_sha256 string")
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))
