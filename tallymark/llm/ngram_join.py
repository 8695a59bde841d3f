"""13. N-gram Jaccard join: size-banded tiles, hashed bitmap signatures that bound the overlap, exact intersection of sorted sets.

Equal sets are one class from the start. Sizes are cut into bands such that two sets that can be linked lie in one band or
in neighbouring ones; a band and the one below it are compared by the band's own scheme. A pair of the scheme differs in
at most H shingles, so of the ``H + 1`` parts that a hash deals the shingles into, one at least is the same in both: the
sum of its hashes is a tile's key, and every link meets in a tile. Nothing is lost by this; no frequent shingle, size or
bucket is left out.

1. In each tile all classes are held against one of the band, the tile's first. That joins groups of near copies with a
   pair for each class and tile at most.
2. Tiles that still hold several components are compared in blocks of ``small`` by ``small``: the classes outside the tile's main
   component with all others. A pair inside one component needs no comparison.

A comparison takes two bitmaps of parities (a shingle flips one bit): the bits that differ are no more than the shingles that
differ, which bounds the overlap from above. Pairs that pass are confirmed on full sets, which meet in cells as in
``near_dedup``. A band's bitmap has 8 bits or more for each shingle by which a linked pair may differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import pick
from tallymark.llm.near_dedup import FEW, Join, distinct_classes, sets, tiled, whole_groups
from tallymark.session import cut, free

_MIX, _SIGN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def band_edges(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Largest size of each band: a band ends at the largest partner of its least size."""
    edges = [0]
    while edges[-1] < most:
        edges.append((edges[-1] + 1) * 100 // percent)
    return np.array(edges, np.int64)


def widest_difference(total, percent: int):
    """Most shingles by which two linked sets of ``total`` shingles together can differ."""
    return total * (100 - percent) // (100 + percent)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def part_keys(own: np.ndarray, scheme: int, parts: int) -> np.ndarray:
    """63-bit keys of the set's parts: of equal parts of one scheme they are equal."""
    mixed = _mixed(own)
    part = ((own >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    low = np.bincount(part, (mixed & np.uint64(0xFFFFFFFF)).astype(float), parts)  # sums stay exact below 2 ** 53
    high = np.bincount(part, (mixed >> np.uint64(32)).astype(float), parts)
    content = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
    place = np.uint64(scheme << 40) + np.arange(parts, dtype=np.uint64)
    return _mixed(content ^ _mixed(place + _SIGN)) >> np.uint64(1)


def parities(own: np.ndarray, width: int) -> bytes:
    """Bitmap of ``width`` bits; every shingle flips one."""
    flipped = np.bincount(((own * _SIGN) >> np.uint64(24) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flipped.astype(np.uint8), bitorder="little").tobytes()


def _signatures(percent: int):
    edges = band_edges(percent)
    parts = [int(widest_difference(2 * int(e), percent)) + 1 for e in edges]

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Replaces ``set`` by its size, its tile keys (the last bit is set in the scheme of the next band) and its bitmap."""
        for b in batches:
            keys, bits = [], []
            for own in b["set"]:
                own = np.asarray(own, np.int64).view(np.uint64)
                if not len(own):
                    keys.append([])
                    bits.append(b"")
                    continue
                k = int(np.searchsorted(edges, len(own)))
                here, next_ = part_keys(own, k, parts[k]), part_keys(own, k + 1, parts[k + 1])
                keys.append(np.concatenate([here << np.uint64(1), next_ << np.uint64(1) | np.uint64(1)]).view(np.int64))
                bits.append(parities(own, max(64, 1 << (8 * parts[k] - 1).bit_length())))
            yield b.drop(columns="set").assign(n_shingles=[len(x) for x in b["set"]], keys=keys, bits=bits)

    return signed


def _bitmaps(column: pd.Series, fold: int | None = None) -> np.ndarray:
    """Rows of 64-bit words, folded to ``fold`` bytes, else to the narrowest of the column."""
    least = fold or min(map(len, column))
    out = np.empty((len(column), least // 8), "<u8")
    for i, raw in enumerate(column):
        words = np.frombuffer(raw, "<u8")
        while 8 * len(words) > least:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        out[i] = words
    return out


def _may_link(differ: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Sizes a, b and ``differ`` bits leave room for a link."""
    most = (a + b - differ) // 2
    most = np.minimum(most, np.minimum(a, b))
    return 100 * most >= percent * (a + b - most)


def _with_first(percent: int):
    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Those pairs (a, b) whose bitmaps leave room for a link."""
        for b in batches:
            ok = np.zeros(len(b), bool)
            for width, at in b.groupby(np.minimum(b["a_bits"].str.len(), b["b_bits"].str.len())).indices.items():
                part = b.iloc[at]
                differ = np.bitwise_count(_bitmaps(part["a_bits"], width) ^ _bitmaps(part["b_bits"], width)).sum(1, dtype=np.int64)
                ok[at] = _may_link(differ, part["a_n"].to_numpy(), part["b_n"].to_numpy(), percent)
            yield b.loc[ok, ["a", "b"]]

    return bounded


def _across(percent: int):
    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of a tile's visitors and members in different components, one of the scheme's own band, that may be linked."""
        for b, groups in whole_groups(batches, "key", "tile"):
            role, outside, own, n, cls, chunk = (b[c].to_numpy() for c in ("role", "outside", "own", "n_shingles", "cls", "chunk"))
            component = pd.factorize(b["component"])[0]
            for a, z in groups:
                x, y = np.flatnonzero(role[a:z] & 1) + a, np.flatnonzero(role[a:z] & 2) + a
                if not len(x) or not len(y):
                    continue
                bits = _bitmaps(b["bits"].iloc[a:z])
                differ = np.zeros((len(x), len(y)), np.int64)
                for word in bits.T:
                    differ += np.bitwise_count(word[x - a][:, None] ^ word[y - a][None])
                can = _may_link(differ, n[x][:, None], n[y][None], percent)
                can &= (component[x][:, None] != component[y][None]) & (own[x][:, None] | own[y][None])
                i, j = np.nonzero(can)
                x, y = x[i], y[j]
                low = np.array([p < q for p, q in zip(cls[x], cls[y])], bool)
                once = ~outside[y] | low
                x, y, low = x[once], y[once], low[once]
                if len(x):
                    one, two = np.where(low, x, y), np.where(low, y, x)
                    yield pd.DataFrame({"a": cls[one], "b": cls[two], "a_chunk": chunk[one], "b_chunk": chunk[two]})

    return across


def _tiles(join: Join, held: DataFrame, small: int) -> DataFrame:
    """Step 2: pairs (a, b, a_chunk, b_chunk) of the tiles ``held`` (key, cls, own) that hold several components."""
    rows = held.join(join.labelled(), "cls").withColumn("c", F.xxhash64("component"))
    several = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("key")
    rows = cut(rows.join(several, "key"))
    join.scratch.append(rows)
    shares = rows.groupBy("key", "c").agg(F.count("*").alias("n"))
    main = shares.groupBy("key").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("size"))
    main = main.select("key", F.col("m.c").alias("main"), "size", (F.col("size") - F.col("m.n")).alias("out"))
    blocks = lambda n: F.ceil(F.col(n) / small).cast("int")
    mine = rows.join(main, "key").withColumns({"outside": F.col("c") != F.col("main"), "at": F.pmod(F.xxhash64("cls"), blocks("size")), "by": F.pmod(F.xxhash64("cls", F.lit(1)), blocks("out"))})
    keep = ["key", "cls", "own", "outside"]
    one = F.col("size") <= small  # a single tile, where a row is visitor and member
    members = mine.select(*keep, F.when(one & F.col("outside"), 3).otherwise(2).alias("role"), "at", "size", F.explode(F.sequence(F.lit(0), blocks("out") - 1)).alias("by"))
    visitors = mine.filter(~one & F.col("outside")).select(*keep, F.lit(1).alias("role"), "by", "size", F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("at"))
    both = members.unionByName(visitors).withColumn("tile", F.col("by") * blocks("size") + F.col("at")).select(*keep, "role", "tile")
    own = join.labelled_of(mine, "n_shingles", "bits").join(join.chunks(), "cls", "left").withColumn("chunk", F.coalesce("chunk", F.xxhash64("cls")))
    schema = "a binary, b binary, a_chunk long, b_chunk long"
    return cut(tiled(both.join(own, "cls"), "key").mapInPandas(_across(join.percent), schema).distinct())


def ngram_components(docs: DataFrame, doc_id="doc_id", text="text", k: int = 3, percent: int = 90, small: int = 256) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, and ``tie``, a hash of the text. Exact for every ``percent``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of k-word shingles (with fewer words the
    whole sequence is one); ``component_id`` is the least doc_id reachable. Null or empty text, or one without words,
    has no shingles and is its own component. A null doc_id never is a component's id unless all its documents have none.
    Rows that repeat a doc_id each get a row, linked by their own text. An empty table gives an empty result; further
    columns are not read. A group of different texts that share parts but are not linked costs comparisons with the square of its
    size, in tiles of ``small`` by ``small``.
    """
    docs = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(sets(docs, k).mapInPandas(_signatures(percent), f"doc_id {ids}, tie long, cls binary, n_shingles long, keys array<long>, bits binary"))
    classes = distinct_classes(rows)
    thin = cut(rows.select("doc_id", "tie", "cls", "n_shingles"))
    free(rows)
    numbered = cut(classes.withColumn("num", F.monotonically_increasing_id()))
    free(classes)
    join = Join(docs, k, percent, numbered)
    each = numbered.select("num", F.explode("keys").alias("x")).select("num", F.shiftright("x", 1).alias("key"), (F.col("x").bitwiseAND(F.lit(1)) == 0).alias("own"))
    first = each.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("own"), F.col("num"))).alias("first")).filter("n > 1 AND first IS NOT NULL").drop("n")
    held = cut(each.join(first, "key"))
    pairs = cut(held.filter("num <> first").select("num", "first").distinct())
    # The few classes that share a tile with others: only those are looked up and moved.
    named = numbered.select("num", "cls", F.col("n_shingles").alias("n"), "bits")
    wanted = cut(held.select("num").distinct())
    if wanted.count() <= FEW:
        named = named.join(F.broadcast(wanted), "num", "left_semi")
    named = cut(named)
    side = lambda s: named.select(F.col("num").alias(s), F.col("cls").alias(f"{s}_cls"), F.col("n").alias(f"{s}_n"), F.col("bits").alias(f"{s}_bits"))
    met = pairs.join(side("num"), "num").join(side("first"), "first").select(F.col("num_cls").alias("a"), F.col("first_cls").alias("b"), F.col("num_n").alias("a_n"), F.col("first_n").alias("b_n"), F.col("num_bits").alias("a_bits"), F.col("first_bits").alias("b_bits"))
    met = met.mapInPandas(_with_first(percent), "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = cut(met.withColumns({"a_chunk": F.xxhash64("a"), "b_chunk": F.xxhash64("b")}))
    join.confirm(met)
    free(met, pairs, wanted)
    open_ = held.join(named.select("num", "cls"), "num").select("key", "cls", "own")
    across = _tiles(join, open_, small)
    join.confirm(across)
    found = join.component_ids()
    free(across, held, named)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return thin.join(found, "cls", "left").withColumn("component_id", component).select("doc_id", "n_shingles", "component_id", "tie")
