"""Conversation repair against an exhaustive search over edits and a plain DP that holds whole strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

from tallymark.llm import conversation_repair as C
from tallymark.llm.queries import QUERIES

SEEN = re.compile("[^\x20\x09-\x0d]")
KINDS = "conv_id long, turn long, role string, text string"


def faults(rows):
    """(initial, gone, truncated) of each row, and the counts."""
    out, seen, n = [], set(), dict(blank=0, duplicate=0, truncated=0)
    for role, text in rows:
        marks = SEEN.findall(text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
        if fault:
            n[fault] += 1
        seen.add((role, text))
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    return out, n


def legal(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def exhaustive(rows):
    """Cheapest and least edit string by trying all with up to three inserts, and the repaired lines."""
    told, _ = faults(rows)
    best = None
    for inserts in range(4):
        for at in product(range(len(rows) + 1), repeat=inserts):
            if list(at) != sorted(at):
                continue
            for edits in product("DKR", repeat=len(rows)):
                if any(gone and e != "D" for e, (_, gone, _) in zip(edits, told)):
                    continue
                order = []
                for i in range(len(rows) + 1):
                    order += [("I", None)] * at.count(i) + ([(edits[i], i)] if i < len(rows) else [])
                lines, ok = [], True
                for e, i in order:
                    if e == "D":
                        continue
                    last = lines[-1][0][:1] if lines else ""
                    turn = "assistant" if last == "u" else "user"
                    lines.append(rows[i] if e == "K" else (turn, "" if e == "I" else rows[i][1]))
                if not legal("".join(r[:1] if r else "?" for r, _ in lines)):
                    continue
                audit = "".join(e for e, _ in order)
                cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit) + sum(3 for e, (_, _, t) in zip(edits, told) if t and e != "D")
                if best is None or (cost, audit) < best[:2]:
                    best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return best


def plain(rows):
    """The same by a DP over whole strings."""
    told, _ = faults(rows)

    def inserted(b):
        b = dict(b)
        for s in (0, 1, 3):
            if s in b:
                b[2] = min(b.get(2, (10**9, "")), (b[s][0] + 3, b[s][1] + "I"))
        if 2 in b:
            b[3] = min(b.get(3, (10**9, "")), (b[2][0] + 3, b[2][1] + "I"))
        return b

    best = {0: (0, "")}
    for initial, gone, truncated in told:
        after = defaultdict(lambda: (10**9, ""))
        for s, (c, a) in inserted(best).items():
            after[s] = min(after[s], (c + 4, a + "D"))
            if gone:
                continue
            to = 3 if s == 2 else 2
            after[to] = min(after[to], (c + 3 + 3 * truncated, a + "R"))
            if initial == ("a" if s == 2 else "u"):
                after[to] = min(after[to], (c + 3 * truncated, a + "K"))
            if initial == "s" and s == 0:
                after[1] = min(after[1], (c + 3 * truncated, a + "K"))
        best = dict(after)
    best = inserted(best)
    cost, audit = min(best[s] for s in (0, 3) if s in best)
    lines, at = [], iter(rows)
    for e in audit:
        role, text = (None, "") if e == "I" else next(at)
        if e == "D":
            continue
        turn = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
        lines.append((role if e == "K" else turn, text))
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def report(rows):
    """All columns for the rows (turn, role, text) of one conversation, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {r[0] for r in rows} - {None}
    own = [(r[1], r[2]) for r in rows]
    _, n = faults(own)
    cost, audit, sha = plain(own)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha)


COLUMNS = (*C._COUNTS, "audit", "repaired_sha256")


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", "user", "assistant"], ["Hi.", "Hi", " \n", "", "Why?", "so", "é!", "end. "]
    return [(c, rng.choice([None, *range(most)]), rng.choice(roles), rng.choice(texts)) for c in range(conversations) for _ in range(rng.randint(1, most))]


def grouped(rows):
    out = defaultdict(list)
    for c, *r in rows:
        out[c].append(tuple(r))
    return out


def test_edits_are_the_cheapest_and_least():
    for rows in list(grouped(random_rows(1, 150, 4)).values()):
        own = [(r[1], r[2]) for r in rows]
        assert plain(own) == exhaustive(own)


def test_report_equals_plain_dp_whole_and_in_segments(spark):
    rows = random_rows(2, 120, 12)
    rows += [(1000, i % 90, ("user", "assistant")[i % 3 % 2], ("Well.", f"n{i}", f"Is {i % 70}?")[i % 3]) for i in range(300)]
    want = {c: report(r) for c, r in grouped(rows).items()}
    d = spark.createDataFrame(rows, KINDS).repartition(7)
    for long in (3, 50, C.LONG):
        got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in C.repair_report(d, long=long).collect()}
        assert got == want
    turns = [{(r.conv_id, r.place): (r.edit, r.role, r.text) for r in C.repaired_turns(d, long=long).collect()} for long in (3, C.LONG)]
    assert turns[0] == turns[1]
    own = [turns[0][(1000, i)] for i in range(len(want[1000][6]))]
    assert "".join(e for e, _, _ in own) == want[1000][6]
    assert hashlib.sha256("\n".join(f"{r}:{t}" for e, r, t in own if e != "D").encode()).hexdigest() == want[1000][7]


def test_query_equals_plain_python(spark, sf):
    kept, every = defaultdict(list), set()
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        every.add(r.conv_id)
        case, role, text = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20, r.role, r.text
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        kept[r.conv_id] += [(r.turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_conversation_repair"](spark, sf).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: report(kept[c]) if c in kept else empty for c in every}


def test_odd_rows_and_empty_tables(spark):
    kinds = KINDS + ", k string, place int, audit string"
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (2, 5, "assistant", "word " * 50_000), (2, 9, "user", None), (3, 0, None, "x")]
    d = spark.createDataFrame([(*r, None, None, None) for r in rows], kinds)
    want = {c: report([(t, " " if r is None else r, " " if x is None else x) for t, r, x in own]) for c, own in grouped(rows).items()}
    for long in (1, C.LONG):
        got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in C.repair_report(d, long=long, long_bytes=1_000_000 if long > 1 else 10).collect()}
        assert got == want
    assert want[1][6] == "KDI" and want[1][5] == 7
    assert C.repair_report(d.limit(0)).collect() == [] and C.damage(d.limit(0)).collect() == []
    lost = C.damage(d).collect()
    assert {(r.conv_id, r.turn) for r in lost} <= {(r[0], r[1]) for r in rows}


def test_colliding_hashes_share_nothing(monkeypatch):
    monkeypatch.setattr(C, "_MOD", 3)
    for rows in list(grouped(random_rows(4, 60, 9)).values()):
        own = [(r[1], r[2]) for r in rows]
        told = [dict(turn=0, role=r, text=t, blank=not SEEN.search(t), truncated=(SEEN.findall(t) or "x")[-1] not in ".!?") for r, t in own]
        _, cost, audit = C._solved(told)
        assert (cost, audit) == plain(own)[:2]
