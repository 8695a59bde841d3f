"""4. Near-duplicates by a chosen-path set similarity join over word shingles.

Equal sets are one class from the start. A class has ``HASHES`` minwise tokens of its set (16 bits each). Each of ``trees``
independent trees puts classes into nodes by a path of tokens; its first ``PATH`` steps are taken at once. A pair at the
threshold shares such a path with a chance of 0.8 ** 3, and misses all of 16 trees with one of 1 in 100 000. In a level:

1. Twice, every class of a node is compared with the others there (in a large node with those of its own block, at random
   and anew in each tree) and takes the most alike that isn't in its component yet. The best of these over all trees is
   confirmed on full sets (in the second round the best 8), and components are made. This joins groups of copies with a
   few pairs for each class.
2. Then only classes outside a node's main component matter. Nodes with few of these, or of few tiles, are compared
   exhaustively: the outside ones with the whole node, in tiles. From other nodes classes go on into child nodes by
   further tokens, 1.25 of them on average, so that a pair at the threshold is expected to meet again however deep it
   grows. At ``depth`` all that is left is compared.

A comparison holds set sizes (exact: 100 * smaller >= percent * larger) and the equal tokens against each other: the first
``SHORT`` in step 1, in step 2 those and a byte of each of the others (three standard deviations below the threshold, so
that a pair right at it fails about once in 700 and one at 0.82 hardly ever); a pair is passed on by the first tree where it meets. Links are confirmed on full sets, which meet in cells of at
most ``CELL`` sets of either component, not once for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import lower_ascii, pick, shingles, whole, words
from tallymark.llm.components import components, in_tasks
from tallymark.session import cut, free

HASHES, SHORT, PATH, PART, CELL = 512, 64, 3, 128, 64
#: Tiles of ``small`` by ``small`` classes up to which a node is compared rather than branched, however many are outside.
WORK = 256
#: Most alike classes of others that each class is held against, in the two rounds of step 1.
ASKED = (1, 8)
#: Classes whose sets are wanted that are sent to every task at most, about 50 MB; beyond that they are joined by shuffle.
FEW = 1_000_000
#: Sets of a task where they are written.
SETS = 4_096
_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def _minwise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replaces ``set`` by its size and its minwise tokens: 16 bits of the first ``SHORT``, 8 bits of the others in ``more``."""
    for b in batches:
        least = np.full((len(b), HASHES), np.iinfo(np.uint64).max, np.uint64)
        for row, own in enumerate(b["set"]):
            own = np.asarray(own, np.int64).view(np.uint64)
            for i in range(0, len(own), PART):
                np.minimum(least[row], (own[i : i + PART, None] * _MUL + _ADD).min(0), out=least[row])
        least ^= least >> np.uint64(29)
        tokens = (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype("<u2")
        short, more = tokens[:, :SHORT], tokens[:, SHORT:].astype(np.uint8)
        yield b.drop(columns="set").assign(n_shingles=[len(x) for x in b["set"]], tokens=[x.tobytes() for x in short], more=[x.tobytes() for x in more])


def sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, tie, set and ``cls``, 128 bits of the set's content, for rows (doc_id, text)."""
    found = docs.select("doc_id", F.xxhash64("text").alias("tie"), words(lower_ascii(F.col("text"))).alias("w"))
    found = found.select("doc_id", "tie", F.array_distinct(shingles(F.col("w"), k)).alias("set"))
    content = F.sort_array("set")
    halves = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(content), F.xxhash64(F.lit(7), content))]
    return found.withColumn("cls", F.unhex(F.concat(*halves)))


def whole_groups(batches: Iterator[pd.DataFrame], *key: str) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Frames of whole groups and the groups' row ranges, from batches where a group's rows stand together."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        last = np.ones(len(b), bool)
        for k in key:
            last &= (b[k] == b[k].iloc[-1]).to_numpy()
        at = 0 if last.all() else len(b) - int(np.argmin(last[::-1]))
        if at:
            yield b.iloc[:at].reset_index(drop=True), _ranges(b.iloc[:at], key)
        rest = b.iloc[at:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, _ranges(rest, key)


def _ranges(b: pd.DataFrame, key: tuple[str, ...]) -> list[tuple[int, int]]:
    edge = np.zeros(len(b) - 1, bool)
    for k in key:
        v = b[k].to_numpy()
        edge |= v[1:] != v[:-1]
    cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), len(b)]
    return list(zip(cuts, cuts[1:]))


class _Compare:
    """What two lots of rows of one frame have in common."""

    def __init__(self, b: pd.DataFrame, percent: int):
        self.tokens = np.frombuffer(b"".join(b["tokens"]), "<u2").reshape(len(b), SHORT)
        self.more = np.frombuffer(b"".join(b["more"]), np.uint8).reshape(len(b), HASHES - SHORT) if "more" in b else None
        self.n, self.percent = b["n_shingles"].to_numpy(), percent
        self.component = pd.factorize(b["component"])[0]
        share = percent / 100
        least = lambda n: int(np.ceil(n * (share - 3 * (share * (1 - share) / n) ** 0.5)))
        self.least, self.least_of_all = least(SHORT), least(HASHES)

    def alike(self, x, y) -> np.ndarray:
        """Equal tokens of each of ``x`` with each of ``y``, -1 where the two can't be linked or are in one component."""
        same = (self.tokens[x][:, None] == self.tokens[y][None]).sum(2, dtype=np.int16)
        a, b = self.n[x][:, None], self.n[y][None]
        can = same >= self.least
        if self.more is not None and can.any():
            i, j = np.nonzero(can)
            for at in range(0, len(i), 1 << 14):
                part = slice(at, at + (1 << 14))
                can[i[part], j[part]] = same[i[part], j[part]] + (self.more[x][i[part]] == self.more[y][j[part]]).sum(1) >= self.least_of_all
        can &= (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)) & (self.component[x][:, None] != self.component[y][None])
        return np.where(can, same, -1)


def _best(percent: int, small: int):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (node, tree, size, a, b, alike): each class's most alike one of its tile; in large nodes also those without one."""
        for b, groups in whole_groups(batches, "node", "tile"):
            held = _Compare(b, percent)
            other, most = np.full(len(b), -1), np.full(len(b), -1, np.int32)
            for a, z in groups:
                if z - a > 1:
                    alike = held.alike(slice(a, z), slice(a, z))
                    other[a:z], most[a:z] = alike.argmax(1) + a, alike.max(1)
            cls = b["cls"].to_numpy()
            found = b[["node", "tree", "size"]].assign(a=cls, b=np.where(most >= 0, cls[other], None), alike=most)
            yield found[(most >= 0) | (b["size"].to_numpy() > small)]

    return best


def _across(percent: int, trees: int):
    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (a, b, a_chunk, b_chunk): the pairs of a tile's visitors and members that may be linked, unless an earlier tree has them."""
        for b, groups in whole_groups(batches, "node", "tile"):
            held = _Compare(b, percent)
            path = held.tokens[:, : PATH * trees].reshape(len(b), trees, PATH)
            role, outside, cls, chunk, later = (b[c].to_numpy() for c in ("role", "outside", "cls", "chunk", "later"))
            for a, z in groups:
                x, y = np.flatnonzero(role[a:z] & 1) + a, np.flatnonzero(role[a:z] & 2) + a
                if not len(x) or not len(y):
                    continue
                i, j = np.nonzero(held.alike(x, y) >= 0)
                x, y = x[i], y[j]
                once = ~outside[y] | np.array([p < q for p, q in zip(cls[x], cls[y])], bool)
                x, y = x[once], y[once]
                tree = int(b["tree"].iat[a])
                if tree > 0 and len(x):  # a node that two classes share is the same for both: so is whether it goes on
                    now = later[x][:, None] >> np.arange(tree) & 1 == 0
                    first = ~((path[x][:, :tree] == path[y][:, :tree]).all(2) & now).any(1)
                    x, y = x[first], y[first]
                if len(x):
                    low = np.array([p < q for p, q in zip(cls[x], cls[y])], bool)
                    one, two = np.where(low, x, y), np.where(low, y, x)
                    yield pd.DataFrame({"a": cls[one], "b": cls[two], "a_chunk": chunk[one], "b_chunk": chunk[two]})

    return across


def _linked_in_cells(percent: int):
    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (a, b): those pairs of a cell whose full sets are similar enough."""
        for b, groups in whole_groups(batches, "cell"):
            found = []
            for at, z in groups:
                part = b.iloc[at:z]
                is_set = part["b"].isna().to_numpy()
                own = {c: np.sort(np.asarray(s, np.int64)) for c, s in zip(part["a"][is_set], part["set"][is_set], strict=True)}
                for a, c in zip(part["a"][~is_set], part["b"][~is_set], strict=True):
                    x, y = own[a], own[c]
                    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[place] == x).sum())
                    if both * 100 >= (len(x) + len(y) - both) * percent:
                        found.append((a, c))
            yield pd.DataFrame(found, columns=["a", "b"])

    return linked


class Join:
    """State of one join: classes, confirmed components, and the sets made so far."""

    def __init__(self, docs: DataFrame, k: int, percent: int, classes: DataFrame):
        self.docs, self.k, self.percent, self.classes = docs, k, percent, classes
        self.roots: DataFrame | None = None
        self.few_roots = True
        self.sets: list[DataFrame] = []
        self.scratch: list[DataFrame] = []

    def labelled(self, *columns: str) -> DataFrame:
        """(cls, columns, component)."""
        own = self.classes.select("cls", *columns)
        if self.roots is None:
            return own.withColumn("component", F.col("cls"))
        return own.join(self.named_roots(), "cls", "left").withColumn("component", F.coalesce("root", "cls")).drop("root")

    def named_roots(self) -> DataFrame:
        """(cls, root), sent to every task while these are few: classes then needn't move to learn their component."""
        found = self.roots.select(F.col("v").alias("cls"), "root")
        return F.broadcast(found) if self.few_roots else found

    def labelled_of(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``labelled`` of the classes in ``rows``, so that others don't move where these are few."""
        ids = cut(rows.select("cls").distinct())
        self.scratch.append(ids)
        own = self.labelled(*columns)
        return own.join(F.broadcast(ids), "cls", "left_semi") if ids.count() <= FEW else own

    def chunks(self) -> DataFrame:
        """(cls, chunk) of the classes in components: about ``CELL`` classes of a component are a chunk."""
        if self.roots is None:
            return self.classes.select("cls", F.xxhash64("cls").alias("chunk")).limit(0)
        sizes = self.roots.groupBy("root").agg(F.count("*").alias("n"))
        part = F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / CELL).cast("int"))
        found = self.roots.join(sizes, "root").select(F.col("v").alias("cls"), F.xxhash64("root", part).alias("chunk"))
        return F.broadcast(found) if self.few_roots else found

    def _make_sets(self, pairs: DataFrame, number: int) -> None:
        """Sets of the classes in ``pairs`` that have none yet, from the text of a document of each."""
        ends = in_tasks(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), 2 * number)
        for known in self.sets:
            ends = ends.join(known.select("cls"), "cls", "left_anti")
        wanted = cut(self.classes.join(ends, "cls", "left_semi").select(F.col("doc_id").alias("d"), F.col("tie").alias("t")))
        n = wanted.count()
        if n:
            few = F.broadcast(wanted) if n <= FEW else wanted
            own = self.docs.withColumn("tie", F.xxhash64("text")).join(few, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left_semi")
            made = sets(own.select("doc_id", "text"), self.k).select("cls", "set").dropDuplicates(["cls"])
            self.sets.append(cut(in_tasks(made, n, SETS)))
        free(wanted)

    def confirm(self, pairs: DataFrame) -> int:
        """Adds the links among ``pairs`` (a, b, a_chunk, b_chunk), a table of its own, to the components; the number of pairs."""
        number = pairs.count()
        if not number:
            return 0
        self._make_sets(pairs, number)
        cell = F.xxhash64(F.least("a_chunk", "b_chunk"), F.greatest("a_chunk", "b_chunk")).alias("cell")
        tests = pairs.select("a", "b", cell)
        ends = cut(in_tasks(tests.select("cell", F.col("a").alias("cls")).union(tests.select("cell", "b")).distinct(), 2 * number))
        sets = self.sets[0]
        for more in self.sets[1:]:
            sets = sets.unionByName(more)
        few = F.broadcast(ends) if ends.count() <= FEW else ends
        rows = sets.join(few, "cls").select("cell", F.col("cls").alias("a"), F.lit(None).cast("binary").alias("b"), "set")
        rows = rows.unionByName(tests.select("cell", "a", "b", F.lit(None).cast("array<bigint>").alias("set")))
        found = cut(rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(_linked_in_cells(self.percent), "a binary, b binary"))
        if not found.isEmpty():
            self._link(found)
        free(ends, found)
        return number

    def _link(self, links: DataFrame) -> None:
        """Joins the components at the two ends of ``links`` (a, b): only their roots meet, not all that are in them."""
        before = self.roots
        if before is None:
            self.roots = components(links)
        else:
            for end in ("a", "b"):
                links = links.join(self.named_roots().withColumnRenamed("cls", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
            new = components(links)
            n = new.count()
            step = new.select(F.col("v").alias("root"), F.col("root").alias("further"))
            moved = before.join(F.broadcast(step) if n <= FEW else step, "root", "left")
            self.roots = cut(moved.select("v", F.coalesce("further", "root").alias("root")).unionByName(new.select("v", "root")))
            free(before, new)
        self.few_roots = self.roots.count() <= FEW

    def component_ids(self) -> DataFrame:
        """A table (cls, component_id), the least doc_id of each class's component; frees what the join has held."""
        in_one = self.classes.select("cls", "doc_id")
        if self.roots is None:
            in_one = in_one.withColumn("root", F.col("cls"))
        else:
            in_one = in_one.join(self.named_roots(), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        least = in_one.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        found = cut(in_one.join(least, "root").select("cls", "component_id"))
        free(self.classes, self.roots, *self.sets, *self.scratch)
        return found


def _counted(nodes: DataFrame) -> DataFrame:
    """Rows (node, tree, cls) of nodes with two classes or more, with the node's ``size``."""
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    return cut(nodes.join(sizes, "node"))


def tiled(rows: DataFrame, node: str = "node") -> DataFrame:
    """Rows of each tile of a node together, ordered by class."""
    return rows.repartition(node, "tile").sortWithinPartitions(node, "tile", "cls")


def _branches(node: Column) -> Column:
    """Numbers of the tokens by which a node's classes go on: one, and with a chance of a quarter a second."""
    one, two = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(SHORT)).cast("int"), F.pmod(F.xxhash64(node, F.lit(2)), F.lit(SHORT)).cast("int")
    return F.when((F.pmod(F.xxhash64(node, F.lit(3)), F.lit(4)) == 0) & (one != two), F.array(one, two)).otherwise(F.array(one))


def _level(join: Join, held: DataFrame, trees: int, small: int, last: bool) -> DataFrame | None:
    """Joins what the nodes ``held`` show; the child nodes of those that must go on, if any. ``held`` is freed."""
    schema = "node long, tree int, size long, a binary, b binary, alike int"
    for most in ASKED:
        tile = F.pmod(F.xxhash64("cls", "node"), F.ceil(F.col("size") / small).cast("int")).alias("tile")
        rows = held.select("node", "tree", "size", "cls", tile).join(join.labelled_of(held, "n_shingles", "tokens"), "cls")
        found = cut(tiled(rows).mapInPandas(_best(join.percent, small), schema))
        ranked = F.sort_array(F.collect_set(F.struct("alike", "b")), asc=False)  # one row of each tree at most
        best = found.filter("b is not null").groupBy("a").agg(F.slice(ranked, 1, most).alias("m")).select("a", F.explode("m.b").alias("o"))
        pairs = best.select(F.least("a", "o").alias("a"), F.greatest("a", "o").alias("b")).distinct()
        pairs = cut(pairs.withColumns({"a_chunk": F.xxhash64("a"), "b_chunk": F.xxhash64("b")}))
        met = join.confirm(pairs)
        free(held, pairs)
        held = found.select("node", "tree", F.col("a").alias("cls"), "size")
        held.scratch_path = found.scratch_path
        if not met:
            break

    label = join.labelled()
    rows = cut(held.select("node", "tree", "cls").join(label, "cls"))
    free(held)
    shares = rows.groupBy("node", "component").agg(F.count("*").alias("n"))
    main = shares.groupBy("node").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("size"))
    main = main.select("node", F.col("m.component").alias("main"), "size", (F.col("size") - F.col("m.n")).alias("out")).filter("out > 0")
    left = cut(rows.join(main, "node"))
    free(rows)
    now = (F.col("out") <= small) | (F.col("size") * F.col("out") <= WORK * small * small) | F.lit(last)
    going = left.filter(~now).select("node", "tree", "cls")
    deeper = not last and not going.isEmpty()

    tiles = lambda n: F.ceil(F.col(n) / small).cast("int")
    mine = left.filter(now).withColumns({"outside": F.col("component") != F.col("main"), "at": F.pmod(F.xxhash64("cls"), tiles("size")), "by": F.pmod(F.xxhash64("cls"), tiles("out"))})
    if deeper:
        later = going.filter("tree >= 0").groupBy("cls").agg(F.bit_or(F.pow(F.lit(2), F.col("tree")).cast("int")).alias("later"))
        mine = mine.join(later, "cls", "left").withColumn("later", F.coalesce("later", F.lit(0)))
    else:
        mine = mine.withColumn("later", F.lit(0))
    keep = ["node", "tree", "later", "cls", "outside"]
    one = F.col("size") <= small  # a single tile, where a row is visitor and member
    members = mine.select(*keep, F.when(one & F.col("outside"), 3).otherwise(2).alias("role"), "at", "size", F.explode(F.sequence(F.lit(0), tiles("out") - 1)).alias("by"))
    visitors = mine.filter(~one & F.col("outside")).select(*keep, F.lit(1).alias("role"), "by", "size", F.explode(F.sequence(F.lit(0), tiles("size") - 1)).alias("at"))
    both = members.unionByName(visitors).withColumn("tile", F.col("by") * tiles("size") + F.col("at")).select(*keep, "role", "tile")
    large = join.chunks()
    own = join.labelled_of(mine, "n_shingles", "tokens", "more").join(large, "cls", "left").withColumn("chunk", F.coalesce("chunk", F.xxhash64("cls")))
    schema = "a binary, b binary, a_chunk long, b_chunk long"
    pairs = cut(tiled(both.join(own, "cls")).mapInPandas(_across(join.percent, trees), schema).distinct())
    join.confirm(pairs)
    free(pairs)
    if not deeper:
        free(left)
        return None
    own = going.join(join.classes.select("cls", "tokens"), "cls")
    token = F.substring("tokens", F.col("i") * 2 + 1, F.lit(2))
    child = own.select("cls", "tokens", "node", F.explode(_branches(F.col("node"))).alias("i")).select(F.xxhash64("node", "i", token).alias("node"), F.lit(-1).alias("tree"), "cls")
    child = _counted(child)
    free(left)
    return child


def distinct_classes(rows: DataFrame) -> DataFrame:
    """A table of one row of each class of rows (doc_id, tie, cls, n_shingles, ...) with shingles, that of the least doc_id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    with_words = rows.filter("n_shingles > 0")
    several = with_words.groupBy("cls").agg(first, F.count("*").alias("n")).filter("n > 1")
    several = cut(several.select("cls", F.col("first.doc_id").alias("d"), F.col("first.tie").alias("t")))
    few = F.broadcast(several) if several.count() <= FEW else several
    # What a class's rows have beside their ids is the same in all: only rows of equal sets meet.
    lone = with_words.join(few, "cls", "left_anti")
    one_of = with_words.join(few, "cls").filter(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).drop("d", "t").dropDuplicates(["cls"])
    classes = cut(lone.unionByName(one_of))
    free(several)
    return classes


def _linked(docs: DataFrame, k: int, percent: int, trees: int, small: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, tie, cls, n_shingles) and every class's (cls, component_id)."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(sets(docs, k).mapInPandas(_minwise, f"doc_id {ids}, tie long, cls binary, n_shingles long, tokens binary, more binary"))
    classes = distinct_classes(rows)
    thin = cut(rows.select("doc_id", "tie", "cls", "n_shingles"))
    free(rows)
    rows = thin
    path = lambda t: F.xxhash64(F.lit(t), F.substring("tokens", F.lit(2 * PATH * t + 1), F.lit(2 * PATH)))
    start = F.explode(F.array(*[F.struct(path(t).alias("node"), F.lit(t).alias("tree")) for t in range(trees)])).alias("s")
    join = Join(docs, k, percent, classes)
    held = _counted(classes.select("cls", start).select("s.node", "s.tree", "cls"))
    for level in range(1, depth + 1):
        held = _level(join, held, trees, small, level == depth)
        if held is None or held.isEmpty():
            break
    found = join.component_ids()
    return rows.select("doc_id", "tie", "cls", "n_shingles"), found


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", k: int = 5, percent: int = 80, trees: int = 16, small: int = 256, depth: int = 8) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, and ``tie``, a hash of the text.

    Documents are linked at a similarity of ``percent`` / 100 or more; ``component_id`` is the least doc_id reachable.
    Null or empty text, or one without words, has no shingles and is its own component. A null doc_id never is a
    component's id unless all its documents have none; ``kept`` then is true for those. Rows that repeat a doc_id each
    get a row, linked by their own text. An empty table gives an empty result; further columns are not read.
    """
    rows, found = _linked(pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit(""))), k, percent, trees, small, depth)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    joined = rows.join(found, "cls", "left").withColumn("component_id", component)
    return joined.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "tie")


def keep_one(docs: DataFrame, doc_id="doc_id", text="text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: the least doc_id of each group. Rows equal in id and text stay or go together."""
    kept = near_duplicates(docs, doc_id, text, **options).filter("kept").select(F.col("doc_id").alias("d"), F.col("tie").alias("t")).distinct()
    rows = whole(docs, F.col(f"`{doc_id}`").alias("i"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h"))
    return rows.join(kept, F.col("i").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")), "left_semi").select("row.*")
