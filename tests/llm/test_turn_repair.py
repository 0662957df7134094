"""Repair of turns against every edit there is, on short conversations; pieces of long ones against the whole."""

import hashlib
import random
import re
import zlib

from rastertime.llm import op11, turn_repair
from tests.compare import same
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
VALID = re.compile(r"(s?(ua)+)?")


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_best(rows):
    """(cost, audit, repaired rows) by trying all edits, dearer ones than the best found left aside."""
    faults, best = plain_faults(rows), [10**9, "", ()]

    def go(i, cost, audit, out):
        if cost > best[0] or not re.fullmatch(r"s?(ua)*u?", "".join(r[:1] for r, _ in out)):
            return
        if i == len(rows) and VALID.fullmatch("".join(r[:1] for r, _ in out)) and (cost, audit) < (best[0], best[1]):
            best[:] = cost, audit, out
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, cost + 4, audit + "D", out)
            if faults[i] not in ("b", "d"):
                more = 3 * (faults[i] == "t")
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, cost + more, audit + "K", (*out, (role, text)))
                for new in ("user", "assistant"):
                    go(i + 1, cost + 3 + more, audit + "R", (*out, (new, text)))
        for new in ("user", "assistant"):
            go(i, cost + 3, audit + "I", (*out, (new, "")))

    go(0, 0, "", ())
    return tuple(best)


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def some_rows(rng, n):
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "User", ""]), rng.choice(["Yes.", "no", " ", "Why? \n", f"{rng.random()}!", "é."])) for _ in range(n)]


def test_cheapest_edits(spark):
    rng = random.Random(5)
    talks = {c: some_rows(rng, rng.randrange(1, 6)) for c in range(40)}
    rows = spark.createDataFrame([(c, t, *x) for c, talk in talks.items() for t, x in enumerate(talk)], SCHEMA)
    report = turn_repair.repair(rows)
    hashes = {r.conv_id: r.repaired_sha256 for r in turn_repair.digests(rows, report).collect()}
    lines = {}
    for r in sorted(turn_repair.repaired(rows, report).collect(), key=lambda r: (r.conv_id, r.position)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: r for r in report.collect()}
    for c, talk in talks.items():
        cost, audit, out = plain_best(talk)
        assert (got[c].cost, got[c].audit) == (cost, audit), (talk, got[c])
        assert hashes[c] == digest(out) and lines.get(c, []) == list(out)
        faults, initials = plain_faults(talk), [r[:1] for r, _ in talk]
        assert [got[c].blank, got[c].duplicate, got[c].truncated] == [faults.count(x) for x in "bdt"]
        assert got[c].illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def test_a_long_conversation_over_many_ranges(spark, monkeypatch):
    """One conversation has nearly all rows, falls on several ranges, and gives what one forward pass over it gives."""
    monkeypatch.setattr(turn_repair, "partitions", lambda _: 7)
    rng = random.Random(8)
    talk = [(rng.choice(["user", "assistant", "system"]), rng.choice([f"Text {i}.", f"open {i}", "Again.", ""])) for i in range(3000)]
    rows = spark.createDataFrame([(1, t // 2 * 3, *x) for t, x in enumerate(talk)] + [(0, 0, "user", "Hi."), (2, None, "assistant", "So?")], SCHEMA)
    codes = turn_repair.coded(turn_repair._plain(rows))
    assert codes.where("key = '1'").select("part").distinct().count() > 3
    made = "".join(r.code for r in codes.where("key = '1'").orderBy("at").collect())
    whole = turn_repair.forward(made)
    best = min(whole[s] for s in turn_repair.END if whole[s] is not None)
    report = turn_repair.repair(rows)
    got = {r.conv_id: r for r in report.collect()}
    assert (got[1].cost, got[1].audit) == best and len(got[1].audit.replace("I", "")) == 3000
    assert got[1].gaps == 1499 * 3 + 1 - 1500
    faults = [r.fault for r in codes.where("key = '1'").collect()]
    assert [got[1].blank, got[1].duplicate, got[1].truncated] == [faults.count(x) for x in "bdt"]
    initials = [r.initial for r in codes.where("key = '1'").orderBy("at").collect()]
    assert got[1].illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert (got[0].audit, got[2].audit, got[2].gaps) == ("KI", "IK", 0)
    assert turn_repair.digests(rows, report).count() == 3


def test_composed_layers_are_the_whole():
    rng = random.Random(2)
    for _ in range(200):
        codes = "".join(rng.choice("suaoSUAx") for _ in range(rng.randrange(1, 12)))
        at = rng.randrange(len(codes))
        first, whole = turn_repair.forward(codes[:at]), turn_repair.forward(codes)
        joined = [None] * 4
        for start in range(4):
            if first[start] is not None:
                paths = turn_repair.forward(codes[at:], start)
                joined = [turn_repair._least(p, q and (first[start][0] + q[0], first[start][1] + q[1])) for p, q in zip(joined, paths)]
        assert joined == whole


def test_damage_by_hand(spark, tmp_path):
    rows = [(c, t, ["user", "assistant"][t % 2] if t else None, f"Some. Text {c} {t}!" if t != 3 else None) for c in range(30) for t in range(5)] + [(None, None, "user", "Alone."), (None, 4, "user", "Alone.")]
    given = spark.createDataFrame(rows, SCHEMA)
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        want += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert sorted(map(repr, map(tuple, op11.damaged(given).collect()))) == sorted(map(repr, want))
    given.withColumnsRenamed({}).selectExpr("*", "1 AS audit", "2 AS key", "3 AS of").write.parquet(str(tmp_path / "conversations.parquet"))
    got = op11.query(spark, str(tmp_path)).collect()
    assert len(got) == 31
    for r in got:
        own = sorted((x for x in want if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0))
        if len({x[1] for x in own}) < 4:
            continue
        cost, audit, out = plain_best([x[2:] for x in own])
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, digest(out))


def test_empty_and_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(none).count() == 0
    none.write.parquet(str(tmp_path / "conversations.parquet"))
    assert op11.query(spark, str(tmp_path)).count() == 0
    long = "w " * 300_000 + "end."
    rows = spark.createDataFrame([("x", 1, "user", long), ("x", 1, "user", long), ("x", None, None, None), ("", 2, "assistant", "")], "conv_id string, turn int, role string, text string")
    report = turn_repair.repair(rows)
    got = {r.conv_id: r for r in report.collect()}
    assert (got["x"].audit, got["x"].cost, got["x"].blank, got["x"].duplicate) == ("DDKI", 11, 1, 1) or got["x"].audit == "DKDI"
    assert (got[""].audit, got[""].cost) == ("D", 4)
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.conv_id: r.repaired_sha256 for r in turn_repair.digests(rows, report).collect()}[""] == empty


def test_query_matches_sql(spark, duck):
    import duckdb

    same(op11.query(spark, SF), duck, op11.ORACLE)
    larger = SF.replace("sf0.001", "sf0.01")  # has rows that are repeated at the end of a conversation
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{larger}/conversations.parquet')")
    same(op11.query(spark, larger), con, op11.ORACLE)
