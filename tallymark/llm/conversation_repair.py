"""11. Conversation structure repair: the cheapest edits that give a legal order of roles, by a persistent audit DP.

Edits are K keep, R rerole to user or assistant, D delete, I insert an empty turn. Roles are legal if their initials are
nothing, or an optional s and then ua once or more. The DP holds the cheapest edits for each of four states (nothing,
after s, after u, after a). Edits are nodes that share their prefix: a node has its last edit, its parent, ancestors 1, 2, 4,
.. back, and a rolling hash of the whole prefix. A node is found again by that hash, and only if parent and edit are the same
too, so equal prefixes are one node and a collision merges nothing. Ties are broken by the longest common prefix, searched over the
ancestors, and the edit after it.

Edits that cost the same over the same turns differ before either ends (one that begins the other lacks only inserts, and so
is cheaper). So the least of two stays the least whatever stands before or after both, and parts of a conversation can
be solved apart, from each state to each, and put together: conversations above ``LONG`` turns or ``LONG_BYTES`` are dealt
over many tasks by order and solved in segments; others whole, in one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import cut

#: Turns and bytes of text above which a conversation is solved in segments of ``LONG`` turns.
LONG, LONG_BYTES = 4_096, 1 << 24
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = "\t\n\x0b\x0c\r "
_BASE, _MOD = 1_000_003, (1 << 61) - 1
_USER_FROM, _LEGAL = (0, 1, 3), ("su", "ua", "au")
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "k string, place long, edit string, role string, text string"


class Edits:
    """Prefixes of edits as linked nodes; node 0 is the empty one."""

    def __init__(self):
        self.last, self.depth, self.hash, self.back = [""], [0], [0], [[]]
        self.known: dict[int, list[int]] = {}

    def add(self, parent: int, edit: str) -> int:
        h = (self.hash[parent] * _BASE + ord(edit)) % _MOD
        same = self.known.setdefault(h, [])
        for node in same:
            if self.back[node][0] == parent and self.last[node] == edit:
                return node
        node = len(self.last)
        back, at = [parent], parent
        while len(self.back[at]) >= len(back):  # ancestor 2 ** i is ancestor 2 ** (i-1) of ancestor 2 ** (i-1)
            at = self.back[at][len(back) - 1]
            back.append(at)
        self.last.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append(h)
        self.back.append(back)
        same.append(node)
        return node

    def lifted(self, node: int, steps: int) -> int:
        while steps:
            i = steps.bit_length() - 1
            node = self.back[node][i]
            steps -= 1 << i
        return node

    def less(self, a: int, b: int) -> bool:
        """The edits of ``a`` come before those of ``b``."""
        shorter = self.depth[a] < self.depth[b]
        most = min(self.depth[a], self.depth[b])
        a, b = self.lifted(a, self.depth[a] - most), self.lifted(b, self.depth[b] - most)
        if a == b:
            return shorter
        for i in range(len(self.back[a]) - 1, -1, -1):
            if i < len(self.back[a]) and self.back[a][i] != self.back[b][i]:
                a, b = self.back[a][i], self.back[b][i]
        return self.last[a] < self.last[b]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.last[node])
            node = self.back[node][0]
        return "".join(reversed(out))


Best = list[tuple[int, int] | None]


def _offer(edits: Edits, best: Best, state: int, cost: int, parent: int, edit: str) -> None:
    old = best[state]
    if old is not None and old[0] < cost:
        return
    node = edits.add(parent, edit)
    if old is None or cost < old[0] or edits.less(node, old[1]):
        best[state] = (cost, node)


def _inserted(edits: Edits, best: Best) -> Best:
    """``best`` after inserts; a second pair of them would only cost more."""
    after = list(best)
    for state in _USER_FROM:
        if best[state]:
            _offer(edits, after, 2, best[state][0] + INSERT, best[state][1], "I")
    if after[2]:
        _offer(edits, after, 3, after[2][0] + INSERT, after[2][1], "I")
    return after


def step(edits: Edits, best: Best, initial: str, gone: bool, truncated: bool) -> Best:
    """One more turn: ``gone`` must be deleted."""
    best, after = _inserted(edits, best), [None] * 4
    for state, held in enumerate(best):
        if not held:
            continue
        cost, node = held
        _offer(edits, after, state, cost + DELETE, node, "D")
        if gone:
            continue
        more = TRUNCATED if truncated else 0
        to, wanted = (2, "u") if state in _USER_FROM else (3, "a")
        if initial == wanted:
            _offer(edits, after, to, cost + KEEP + more, node, "K")
        else:
            _offer(edits, after, to, cost + REROLE + more, node, "R")
        if initial == "s" and state == 0:
            _offer(edits, after, 1, cost + KEEP + more, node, "K")
    return after


def finish(edits: Edits, best: Best) -> tuple[int, int, int]:
    """(cost, node, state) of the cheapest legal end."""
    after = _inserted(edits, best)
    ends = [(*after[s], s) for s in (0, 3) if after[s]]
    if len(ends) == 2 and (ends[1][0] < ends[0][0] or ends[1][0] == ends[0][0] and edits.less(ends[1][1], ends[0][1])):
        return ends[1]
    return ends[0]


class Repaired:
    """Turns of a conversation as its edits leave them, in order: a digest, and the rows themselves."""

    def __init__(self):
        self.sha, self.first, self.state = hashlib.sha256(), True, 0

    def out(self, role: str, text: str, state: int) -> tuple[str, str]:
        self.sha.update((("" if self.first else "\n") + f"{role}:{text}").encode())
        self.first, self.state = False, state
        return role, text

    def insert(self) -> tuple[str, str]:
        to = 2 if self.state in _USER_FROM else 3
        return self.out("user" if to == 2 else "assistant", "", to)

    def keep(self, role: str, text: str, edit: str) -> tuple[str, str]:
        if edit == "K" and role[:1] == "s":
            return self.out(role, text, 1)
        to = 2 if self.state in _USER_FROM else 3
        return self.out(role if edit == "K" else ("user", "assistant")[to - 2], text, to)


def applied(edits: Iterator[str], turns: list[tuple[str, str]], repaired: Repaired) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of every edit, role and text null for deletions."""
    at = iter(turns)
    for edit in edits:
        if edit == "I":
            yield edit, *repaired.insert()
            continue
        role, text = next(at)
        yield (edit, None, None) if edit == "D" else (edit, *repaired.keep(role, text, edit))


class Facts:
    """Counts of a run of turns, and what the next run must know."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> tuple[bool, bool]:
        """What the DP must know: the turn goes, the turn is truncated. A turn's first fault counts."""
        duplicate, truncated = duplicate and not blank, truncated and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:  # in order
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        return blank or duplicate, truncated

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; a batch is all that is held."""
    for b in batches:
        names = b.schema.names
        for row in zip(*[c.to_pylist() for c in b.columns]):
            yield dict(zip(names, row))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _put(rows: Iterator[tuple], ddl: str, most: int = 2_048) -> Iterator[pa.RecordBatch]:
    schema, held = _arrow(ddl), []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _solved(rows: list[dict]) -> tuple[Facts, int, str]:
    facts, edits, seen = Facts(), Edits(), set()
    best: Best = [(0, 0), None, None, None]
    for r in rows:
        same = (r["role"], r["text"])
        gone, truncated = facts.add(r["turn"], r["role"][:1], r["blank"], same in seen, r["truncated"])
        seen.add(same)
        best = step(edits, best, r["role"][:1], gone, truncated)
    cost, node, _ = finish(edits, best)
    return facts, cost, edits.text(node)


def _whole(turns: bool):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations one after the other, each held whole."""

        def results(rows: list[dict]) -> Iterator[tuple]:
            facts, cost, audit = _solved(rows)
            repaired, k = Repaired(), rows[0]["k"]
            made = [(k, i, *x) for i, x in enumerate(applied(audit, [(r["role"], r["text"]) for r in rows], repaired))]
            if turns:
                yield from made
            else:
                yield k, facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, repaired.sha.hexdigest()

        def each() -> Iterator[tuple]:
            held: list[dict] = []
            for r in _runs(batches):
                if held and held[0]["k"] != r["k"]:
                    yield from results(held)
                    held = []
                held.append(r)
            if held:
                yield from results(held)

        yield from _put(each(), _TURNS if turns else _REPORT)

    return whole


_SEGMENT = "k string, part int, segment long, at long, role string, text string, summary string"


def _segments(size: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows themselves, numbered within segments, and before each segment's rows (at -1) a summary of it.

        A summary has the facts and, from each state to each, the cheapest edits and their cost.
        """

        def each() -> Iterator[tuple]:
            held = number = count = 0
            k = before = part = None
            for r in _runs(batches):
                if count and (r["k"] != k or count == size):
                    yield k, part, number, -1, None, None, _summary(held, edits, ways)
                    number, count = number + 1, 0
                if not count:
                    held, edits = Facts(), Edits()
                    ways = [[(0, 0) if s == e else None for e in range(4)] for s in range(4)]
                k, part = r["k"], r["part"]
                same = (r["k"], r["turn"], r["role"], r["text"])
                gone, truncated = held.add(r["turn"], r["role"][:1], r["blank"], r["late"] or same == before, r["truncated"])
                before = same
                ways = [step(edits, w, r["role"][:1], gone, truncated) for w in ways]
                yield k, part, number, count, r["role"], r["text"], None
                count += 1
            if count:
                yield k, part, number, -1, None, None, _summary(held, edits, ways)

        yield from _put(each(), _SEGMENT)

    return segments


def _summary(facts: Facts, edits: Edits, ways: list[Best]) -> str:
    import json

    found = [(s, e, w[0], edits.text(w[1])) for s, way in enumerate(ways) for e, w in enumerate(way) if w]
    return json.dumps({"facts": vars(facts), "ways": found})


_PIECE = "k string, part int, segment long, at long, role string, text string, summary string"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of a conversation in order to one row a segment: the edits chosen there, and in the first all counts."""
    import json

    def chosen(k: str, rows: list[dict]) -> Iterator[tuple]:
        total, best = Facts(), {0: (0, None)}  # the edits so far: text of the last segment, and what stands before
        for r in rows:
            s = json.loads(r["summary"])
            f, after = s["facts"], {}
            for begin, end, cost, text in s["ways"]:
                if begin in best:
                    way = (best[begin][0] + cost, (text, best[begin][1]))
                    if end not in after or way[0] < after[end][0] or way[0] == after[end][0] and _before(way[1], after[end][1]):
                        after[end] = way
            best = after
            for name in ("blank", "duplicate", "truncated"):
                setattr(total, name, getattr(total, name) + f[name])
            total.illegal += f["illegal"] + (total.last is not None and total.last + f["first"] not in _LEGAL)
            total.last = f["last"]
            if f["low"] is not None:
                total.turns += f["turns"] - (total.high == f["low"])
                total.low, total.high = f["low"] if total.low is None else total.low, f["high"]
        edits, last = Edits(), None
        for end, (cost, way) in best.items():  # the last inserts
            closed: Best = [None] * 4
            closed[end] = (0, 0)
            more, node, _ = finish(edits, closed)
            way = (cost + more, (way[0] + edits.text(node), way[1]))
            if last is None or way[0] < last[0] or way[0] == last[0] and _before(way[1], last[1]):
                last = way
        cost, way = last
        texts = []
        while way:
            texts.append(way[0])
            way = way[1]
        texts.reverse()
        report = json.dumps([total.gaps(), total.blank, total.duplicate, total.truncated, total.illegal, cost])
        for i, (r, text) in enumerate(zip(rows, texts)):
            yield k, r["part"], r["segment"], -1, None, text, report if i == 0 else ""

    def each() -> Iterator[tuple]:
        held: list[dict] = []
        for r in _runs(batches):
            if held and held[0]["k"] != r["k"]:
                yield from chosen(held[0]["k"], held)
                held = []
            held.append(r)
        if held:
            yield from chosen(held[0]["k"], held)

    yield from _put(each(), _PIECE, 64)


def _before(a: tuple, b: tuple) -> bool:
    """The edits of ``a`` come before those of ``b``, chains of as many segments; only what follows their last common one is read."""
    x, y = [], []
    while a is not b:
        x.append(a[0])
        y.append(b[0])
        a, b = a[1], b[1]
    return "".join(reversed(x)) < "".join(reversed(y))


def _streamed(turns: bool):
    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns of long conversations in order, one at a time, with the edits of their segment before them."""
        import json

        def each() -> Iterator[tuple]:
            k, state, report, audit, rest, place = None, None, [], [], iter(()), 0

            for r in _runs(batches):
                if r["at"] == -1:
                    if state is not None:
                        out = [(k, place + i, "I", *state.insert()) for i, _ in enumerate(rest)]  # after a segment's last turn
                        place += len(out)
                        if turns:
                            yield from out
                    if state is None or r["k"] != k:
                        if state is not None and not turns:
                            yield k, *report, "".join(audit), state.sha.hexdigest()
                        k, state, report, audit, place = r["k"], Repaired(), json.loads(r["summary"]), [], 0
                    audit.append(r["text"])
                    rest = iter(r["text"])
                    continue
                for edit in rest:
                    made = (edit, *state.insert()) if edit == "I" else (edit, None, None) if edit == "D" else (edit, *state.keep(r["role"], r["text"], edit))
                    if turns:
                        yield k, place, *made
                    place += 1
                    if edit != "I":
                        break
            if state is not None:
                for _ in rest:
                    made = state.insert()
                    if turns:
                        yield k, place, "I", *made
                    place += 1
                if not turns:
                    yield k, *report, "".join(audit), state.sha.hexdigest()

        yield from _put(each(), _TURNS if turns else _REPORT)

    return streamed


def _facts(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    told = rows.select(F.col(f"`{conv_id}`").cast("string").alias("k"), F.col(f"`{turn}`").cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    end = F.rtrim("text", F.lit(WHITE))
    return told.withColumns({"blank": F.length(end) == 0, "truncated": ~F.right(end, F.lit(1)).isin(".", "!", "?")})


def _work(conversations: DataFrame, names: tuple[str, str, str, str], long: int, long_bytes: int, turns: bool) -> DataFrame:
    told = _facts(conversations, *names)
    large = cut(told.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).filter((F.col("n") > long) | (F.col("bytes") > long_bytes)).select(F.col("k").alias("l")))
    order = ["k", "turn", "role", "text"]
    ddl = _TURNS if turns else _REPORT
    few = told.join(large, F.col("k").eqNullSafe(F.col("l")), "left_anti")
    found = few.repartition("k").sortWithinPartitions(*order).mapInArrow(_whole(turns), ddl)
    if large.isEmpty():
        return found
    many = told.join(large, F.col("k").eqNullSafe(F.col("l")), "left_semi").withColumn("digest", F.sha2("text", 256))
    first = many.groupBy(F.col("k").alias("fk"), F.col("role").alias("fr"), F.col("digest").alias("fd")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("f"))
    many = many.join(first, F.col("k").eqNullSafe(F.col("fk")) & (F.col("role") == F.col("fr")) & (F.col("digest") == F.col("fd")))
    many = many.select(*order, "blank", "truncated", (~F.col("turn").eqNullSafe(F.col("f.turn"))).alias("late"))
    dealt = many.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    parts = cut(dealt.mapInArrow(_segments(long), _SEGMENT))
    place = ["k", "part", "segment", "at"]
    pieces = parts.filter("at = -1").repartition("k").sortWithinPartitions(*place).mapInArrow(_folded, _PIECE)
    both = cut(parts.filter("at >= 0").unionByName(pieces))
    return found.unionByName(both.repartition("k").sortWithinPartitions(*place).mapInArrow(_streamed(turns), ddl))


def repair_report(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text", long: int = LONG, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by number, nulls first, then role and text. Null role or text counts as one space; a null conv_id is a
    conversation of its own. A turn's first fault counts: blank, duplicate (role and text seen earlier), truncated (last
    character but white space not one of ``.!?``). ``audit`` has the initials of the cheapest edits, of equal ones the
    ASCII-least, and ``repaired_sha256`` is of the repaired ``role:text`` lines. An empty table gives an empty result; further
    columns are not read. A task holds one conversation of at most ``long`` turns and ``long_bytes``; of longer ones a segment of
    ``long`` turns, where segments are put together one audit for each state, and where the digest is made one turn and the audit.
    """
    found = _work(conversations, (conv_id, turn, role, text), long, long_bytes, False)
    kind = conversations.schema[conv_id].dataType
    return found.select(F.col("k").cast(kind).alias("conv_id"), *_COUNTS, "audit", "repaired_sha256")


def repaired_turns(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text", long: int = LONG, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Every edit as a row: conv_id, place, edit, and the repaired role and text, null for deletions. See ``repair_report``."""
    found = _work(conversations, (conv_id, turn, role, text), long, long_bytes, True)
    return found.select(F.col("k").cast(conversations.schema[conv_id].dataType).alias("conv_id"), "place", "edit", "role", "text")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn``, nulls as one space: of 20 cases 0 drops the row, 1 empties
    its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case: Column = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    told = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), case.alias("case")).filter("case <> 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return told.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")
