"""N-gram Jaccard join: an exact metric-space join, and the classes that its links form.

The distance of two documents is 1 - |intersection| / |union| of their shingle sets, a metric; linked are documents within r.
Unrelated texts are all at a distance near 1 from any pivot, so pivots taken from the whole corpus separate nothing. A
filter without loss comes first: two linked sets of at most b shingles differ in at most d = 2 b (1 - t) / (1 + t) of them,
so of more than d parts of the hash space at least one is equal in both. Documents with an equal part share a cell, and
cells are what the join divides:

- Some members of a cell are its pivots. A pivot's region holds the members within 2 r of it: those within r, which it links,
  and those in the window between r and 2 r, which may be linked to the former by the triangle inequality.
- Members within r of no pivot, those in windows among them, are the cell that is left. A linked pair is in one region, if one of
  them is within r of a pivot, or both are left. In a region only the window has to meet those within r.
- Cells and regions whose members are of one class are done. Those of more than LEAF members are divided again, with more pivots;
  in the others, and in those that pivots do not divide, members of different classes meet, in blocks of at most LEAF.

Every step is a Spark job over (cell, document) rows. Distances are exact; a histogram of each set over the hash space, whose
L1 distance is at most that of the sets, spares most texts the comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm._shared import NULL_ID, ROW_KEY, connected_components, row_key, written
from tidepool.llm._words import Spans, Words, batch_words, lean, mix

SHINGLE, PERCENT = 3, 90
#: Ratio of a size band's ends, and the share of parts above the least number, so that parts of few shingles can be passed over.
BAND, SLACK = 1.3, 0.1
#: Pivots of a cell in the first round; each later round has so many times more. Rounds of pivots, at most.
PIVOTS, MORE, ROUNDS = 1, 2, 3
#: Members of a cell that one task compares with each other.
LEAF = 2_000
#: Members of a pivot's region that one task compares with it.
BLOCK = 5_000
#: Members up to this number (48 bytes each) are sent to every executor to pick their texts; more meet them in a shuffle.
BROADCAST_MEMBERS = 500_000


def _bands(percent: int, upto: int) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, largest difference, parts) of each band until one is too large to be compared with `upto`."""
    out, low = [], 1
    while not out or out[-1][0] <= upto * 100 // percent + 1:
        high = max(low, int(low * BAND))
        differ = 2 * high * (100 - percent) // (100 + percent)
        out.append((low, high, differ, differ + 2 + int((differ + 1) * SLACK)))
        low = high + 1
    return out


def shingle_sets(w: Words, shingle: int):
    """The sorted distinct shingle hashes of each document of a piece; the whole sequence where it is shorter."""
    spans, at = Spans(w.hash), np.arange(len(w.hash))
    grams = spans.hash(at[: max(0, len(at) - shingle + 1)], at[: max(0, len(at) - shingle + 1)] + shingle)
    for d in range(w.docs):
        a, b = w.offsets[d], w.offsets[d + 1]
        if b - a >= shingle:
            yield np.unique(grams[a : b - shingle + 1])
        else:
            yield spans.hash(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)


def _part_keys(v: np.ndarray, sums: np.ndarray, band: int, differ: int, parts: int) -> np.ndarray:
    """Keys of the parts, without those of fewest shingles: of two sets that differ in `differ` shingles at least parts - differ parts
    are equal, so the one that passes over more of them still leaves one, and what it keeps the other keeps too."""
    part = ((v >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    count = np.bincount(part.astype(np.int64), minlength=parts)
    end = np.cumsum(count)
    keys = mix(sums[end] - sums[end - count] + mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)))
    return keys[count >= np.partition(count, parts - differ - 1)[parts - differ - 1]]


def set_sums(v: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Mixed shingles and two sums of them that name the set."""
    m = mix(v * np.uint64(0xE7037ED1A0B428DB))
    return m, int(m.sum(dtype=np.uint64)), int(mix(m + np.uint64(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64))


def histogram(v: np.ndarray) -> np.ndarray:
    """Counts of a set over equal parts of the hash space, the power of two below the number of shingles."""
    cells = 1 << max(2, len(v).bit_length() - 1)
    return np.minimum(np.bincount((v >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the number of shingles that are in one of two sets only, from their histograms."""
    if len(x) < len(y):
        x, y = y, x
    if x.max() == 255 or y.max() == 255:
        return 0
    return int(np.abs(x.reshape(len(y), -1).sum(1, dtype=np.int64) - y).sum())


def _profiles(shingle: int, percent: int):
    """Row key, size and sums of each set; keys and histogram of those that the task has not seen before."""

    def run(batches):
        bands, seen = _bands(percent, 1000), set()
        for b in batches:
            n, s1, s2, keys, counts = [], [], [], [], []
            for w in batch_words(b.column(4), lower=True):
                for v in shingle_sets(w, shingle):
                    m, x, y = set_sums(v)
                    n.append(len(v))
                    s1.append(x)
                    s2.append(y)
                    own, cells = [], None
                    if len(v) and x not in seen:
                        seen.add(x)
                        cells = histogram(v).tobytes()
                        if len(v) * 100 >= bands[-1][0] * percent:
                            bands = _bands(percent, 2 * len(v))
                        sums = np.zeros(len(v) + 1, np.uint64)
                        np.cumsum(m, out=sums[1:])
                        k = next(i for i, z in enumerate(bands) if z[1] >= len(v))
                        own.append(_part_keys(v, sums, k, *bands[k][2:]))
                        while len(v) * 100 >= bands[k + 1][0] * percent:
                            k += 1
                            own.append(_part_keys(v, sums, k, *bands[k][2:]))
                    keys.append(np.concatenate(own) if own else np.zeros(0, np.uint64))
                    counts.append(cells)
            offsets = np.concatenate([[0], np.cumsum([len(z) for z in keys])]).astype(np.int32)
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64()), *(pa.array(np.array(z, np.uint64).view(np.int64)) for z in (s1, s2)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(counts, pa.binary())], names=["doc_id", *ROW_KEY, "n", "s1", "s2", "keys", "cells"])

    return run


def _possible(percent: int):
    """(p, x, divides, sizes, histograms) -> p, x, divides of the pairs that may have `percent` in common."""

    def run(batches):
        for b in batches:
            n, m = b.column(3).to_numpy(), b.column(4).to_numpy()
            most, keep = (100 - percent) * (n + m) // (100 + percent), []
            for i in np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m)).tolist():
                if least_difference(np.frombuffer(b.column(5)[i].as_buffer(), np.uint8), np.frombuffer(b.column(6)[i].as_buffer(), np.uint8)) <= most[i]:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(keep, pa.int64())) for k in range(3)], names=["p", "x", "divides"])

    return run


def _compared(shingle: int, percent: int, wide: int):
    """(p, x, divides, text) by p, the pivot's own row first -> p, x, divides, linked of the members with at least `wide` percent in common with it."""

    def run(batches):
        pivot, own = None, None
        for b in batches:
            p, x, row, out = b.column(0).to_numpy(), b.column(1).to_numpy(), 0, ([], [])
            for w in batch_words(b.column(3), lower=True):
                for v in shingle_sets(w, shingle):
                    if p[row] == x[row]:
                        pivot, own = p[row], v
                    else:
                        assert pivot == p[row]
                        at = np.searchsorted(own, v)
                        both = int((own[np.minimum(at, len(own) - 1)] == v).sum())
                        union = len(v) + len(own) - both
                        if 100 * both >= wide * union:
                            out[0].append(row)
                            out[1].append(100 * both >= percent * union)
                    row += 1
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(out[0], pa.int64())) for k in range(3)), pa.array(out[1], pa.bool_())], names=["p", "x", "divides", "linked"])

    return run


def _cells(profile: DataFrame) -> DataFrame:
    """cell, x, size of the parts that different sets share; size is the number of sets that share the part."""
    cell = Window.partitionBy("cell")
    parts = profile.select(F.explode("keys").alias("cell"), F.col("s1").alias("x"))
    shared = parts.withColumn("lo", F.min("x").over(cell)).withColumn("hi", F.max("x").over(cell)).withColumn("size", F.count("*").over(cell)).where("lo <> hi")
    return shared.select("cell", "x", "size").distinct()


def _leaf_pairs(percent: int):
    """(cell, a, b, x, kind, class, n, cells) by cell and blocks a, b -> p, x of members of different classes that may be linked."""

    def pairs(group):
        x, kind, klass, n, side, cells = group
        order = np.argsort(n, kind="stable")
        x, kind, klass, n, side = (np.array(z)[order] for z in (x, kind, klass, n, side))
        cells = [np.frombuffer(cells[i], np.uint8) for i in order]
        width = min(map(len, cells))
        exact = np.array([c.max() < 255 for c in cells])
        h = np.array([c if len(c) == width else np.minimum(c.reshape(width, -1).sum(1, dtype=np.int64), 255) for c in cells], np.uint8)
        exact &= h.max(1) < 255
        for i in range(len(x) - 1):
            end = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
            if end <= i + 1:
                continue
            rest = slice(i + 1, end)
            # two blocks meet each other only; two that lie near a pivot are linked by it, two of a window meet elsewhere
            meet = (klass[rest] != klass[i]) & (side[rest] != side[i] if side[0] >= 0 else True) & ((kind[rest] == _CELL) | (kind[rest] != kind[i]))
            if not meet.any():
                continue
            j = i + 1 + np.flatnonzero(meet)
            low = (np.maximum(h[j], h[i]) - np.minimum(h[j], h[i])).sum(1, dtype=np.int64)
            low[~(exact[j] & exact[i])] = 0
            yield from ((x[i], y) for y in x[j[low <= (100 - percent) * (n[j] + n[i]) // (100 + percent)]])

    def run(batches):
        key, group = None, None
        for b in batches:
            out = []
            for c, u, v, own, x, kind, klass, n, cells in zip(*(b.column(k).to_pylist() for k in range(9)), strict=True):
                if (c, u, v) != key:
                    if group and len(group[0]) > 1:
                        out += pairs(group)
                    key, group = (c, u, v), tuple([] for _ in range(6))
                for z, value in zip(group, (x, kind, klass, n, own if u != v else -1, cells), strict=True):
                    z.append(value)
            yield _pairs_batch(out)
        if group and len(group[0]) > 1:
            yield _pairs_batch(list(pairs(group)))

    return run


def _pairs_batch(out: list) -> pa.RecordBatch:
    p, x = zip(*out, strict=True) if out else ((), ())
    p, x = np.array(p, np.int64), np.array(x, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, x)), pa.array(np.maximum(p, x))], names=["p", "x"])


def _met_in_leaves(open_: DataFrame, members: DataFrame, percent: int, leaf: int) -> DataFrame:
    """p, x of the members of open cells that may be linked and are not of one class yet."""
    blocks = open_.groupBy("cell").agg(F.ceil(F.count("*") / leaf).cast("int").alias("blocks"))
    rows = open_.join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "x", "kind", "class")
    rows = rows.join(members.select(F.col("s1").alias("x"), "n", "cells"), "x").select("cell", "a", "b", "own", "x", "kind", "class", "n", "cells")
    rows = rows.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    return rows.mapInArrow(lean(_leaf_pairs(percent)), "p long, x long").distinct()


def _near_pivots(percent: int):
    """(cell, block, pivot, x, kind, class, n, cells) by cell and block, pivots first -> p, x, divides of the pivots and members of
    different classes that may have `percent` in common."""

    def run(batches):
        key, pivots = None, []
        for b in batches:
            out = ([], [], [])
            for c, u, pivot, x, kind, klass, n, cells in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if (c, u) != key:
                    key, pivots = (c, u), []
                h = np.frombuffer(cells, np.uint8)
                if pivot:
                    pivots.append((x, klass, n, h))
                    continue
                for p, p_class, m, g in pivots:
                    if klass != p_class and 100 * min(n, m) >= percent * max(n, m) and least_difference(g, h) <= (100 - percent) * (n + m) // (100 + percent):
                        out[0].append(p)
                        out[1].append(x)
                        out[2].append(kind == _CELL)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["p", "x", "divides"])

    return run


def _met_pivots(open_: DataFrame, chosen: DataFrame, members: DataFrame, percent: int, block: int) -> DataFrame:
    """p, x, divides of the pivots (cell, p, p_class) and members of open cells that may have `percent` in common. Each block of a
    cell meets all its pivots in one task, so what the histograms reject is never a row."""
    blocks = open_.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = open_.where(F.col("kind") != _WINDOW).join(blocks, "cell").select("cell", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("pivot"), "x", "kind", "class")
    own = chosen.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("pivot"), F.col("p").alias("x"), F.lit(_CELL).alias("kind"), F.col("p_class").alias("class"))
    rows = rows.unionByName(own).join(members.select(F.col("s1").alias("x"), "n", "cells"), "x").select("cell", "block", "pivot", "x", "kind", "class", "n", "cells")
    rows = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("pivot"))
    met = rows.mapInArrow(lean(_near_pivots(percent)), "p long, x long, divides boolean")
    return met.groupBy("p", "x").agg(F.max("divides").alias("divides"))


def _possible_pairs(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, x, divides) that may have `percent` in common, by the histograms of both."""
    sizes = members.select("s1", "n", "cells")
    sized = lambda c: sizes.select(F.col("s1").alias(c), F.col("n").alias(f"n_{c}"), F.col("cells").alias(f"c_{c}"))
    return pairs.join(sized("p"), "p").join(sized("x"), "x").select("p", "x", "divides", "n_p", "n_x", "c_p", "c_x").mapInArrow(lean(_possible(percent)), "p long, x long, divides boolean")


def _distances(possible: DataFrame, members: DataFrame, shingle: int, percent: int, wide: int) -> DataFrame:
    """p, x, divides, linked of the pairs (p, x, divides) that have at least `wide` percent in common."""
    possible = written(possible, "possible")
    blocks = possible.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = possible.join(blocks, "p").select("p", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"), "x", "divides")
    own = blocks.select("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("p").alias("x"), F.lit(False).alias("divides"))
    rows = dealt.unionByName(own).join(members.select(F.col("s1").alias("x"), "text"), "x")
    rows = rows.repartition("p", "block").sortWithinPartitions("p", "block", F.col("p") != F.col("x"))
    return rows.select("p", "x", "divides", "text").mapInArrow(lean(_compared(shingle, percent, wide)), "p long, x long, divides boolean, linked boolean")


_CELL, _NEAR, _WINDOW = 0, 1, 2


def _links(cells: DataFrame, members: DataFrame, shingle: int, percent: int, leaf: int) -> tuple[DataFrame, list[dict[str, int]]]:
    """(node, component) of all members that are linked to a smaller one, directly or not; and what each round did.

    Rows (cell, x, kind, class) are open: kind tells members of a cell from those near a region's pivot and in its window.
    """
    spark = cells.sparkSession
    # sets that share parts with most others lie in the middle of what is linked, and are the same in many cells
    shares = written(cells.groupBy("x").agg((-F.sum("size")).alias("order")), "shares")
    open_ = cells.join(shares, "x").select("cell", "x", F.lit(_CELL).alias("kind"), F.col("x").alias("class"), "order")
    component, rounds, pivots = spark.createDataFrame([], "node long, component long"), [], PIVOTS

    def joined(judged):
        rounds.append(judged.agg(F.countDistinct("p").alias("pivots"), F.count("*").alias("within"), F.count_if("linked").alias("linked")).first().asDict())
        edges = component.unionByName(judged.where("linked").select(F.col("x").alias("node"), F.col("p").alias("component")))
        return written(connected_components(edges, "node", "component"), "component")

    while len(rounds) < ROUNDS:
        nth = F.row_number().over(Window.partitionBy("cell").orderBy("order", "x"))
        chosen = open_.where(F.col("kind") != _NEAR).withColumn("nth", nth).where(F.col("nth") <= pivots).select("cell", F.col("x").alias("p"), F.col("class").alias("p_class"))
        met = open_.where(F.col("kind") != _WINDOW).join(chosen, "cell")
        wide = max(0, 2 * percent - 100)
        if pivots == 1:
            # one pivot a cell: at most a pair for each row
            pairs = met.where("class <> p_class").groupBy("p", "x").agg(F.max(F.col("kind") == _CELL).alias("divides"))
            possible = _possible_pairs(pairs, members, wide)
        else:
            possible = _met_pivots(open_, chosen, members, wide, leaf)
        judged = written(_distances(possible, members, shingle, percent, wide), "judged")
        linked = judged.where("linked").select("p", "x")
        component = joined(judged)
        # pivots leave, and what is within r of one leaves the cell for the pivot's region
        gone = met.where(F.col("kind") == _CELL).join(linked, ["p", "x"]).select("cell", "x").unionByName(chosen.select("cell", F.col("p").alias("x"))).distinct()
        rest = open_.select("cell", "x", "kind", "order").join(gone, ["cell", "x"], "left_anti")
        region = judged.where("divides").select(F.xxhash64("p", F.lit(len(rounds))).alias("cell"), "x", F.when(F.col("linked"), _NEAR).otherwise(_WINDOW).alias("kind")).join(shares, "x")
        left = rest.unionByName(region).join(component.withColumnRenamed("node", "x"), "x", "left").select("cell", "x", "kind", F.coalesce("component", "x").alias("class"), "order")
        left = written(left, "left")
        near = F.max(F.when(F.col("kind") == _NEAR, F.col("class")))
        of_cell = left.groupBy("cell").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("kind").alias("least"), F.max("kind").alias("most"), near.alias("near_class"))
        of_cell = of_cell.where((F.col("lo") != F.col("hi")) & ((F.col("most") == _CELL) | ((F.col("least") == _NEAR) & (F.col("most") == _WINDOW)))).select("cell", "near_class")
        # a window member of the region's class has nothing left to show
        open_ = left.join(of_cell, "cell").where((F.col("kind") != _WINDOW) | (F.col("class") != F.col("near_class"))).select("cell", "x", "kind", "class", "order")
        open_ = written(open_, "open")
        largest = open_.groupBy("cell").count().agg(F.max("count")).first()[0]
        if largest is None:
            return component, rounds
        if largest <= leaf:
            break
        pivots *= MORE
    found = _met_in_leaves(open_, members, percent, leaf).withColumn("divides", F.lit(False))
    return joined(written(_distances(_possible_pairs(found, members, percent), members, shingle, percent, percent), "judged")), rounds


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Classes of documents whose shingle sets have 100 * |intersection| >= percent * |union|.

    Words are lower-cased (A-Z) runs other than space and \\x09-\\x0D; a text with fewer words than a shingle is one shingle.
    Returns doc_id, n_shingles, component_id (smallest id reachable by links, itself included), one row per input row.

    Null, empty and wordless texts have no shingles and link with nothing. Null ids sort after all others, and a class of
    null ids only has a null component_id; rows that share an id but not the text are linked by their texts alone. Repeated
    rows are links of distance 0. Texts are read whole, whatever their length. Other columns are ignored; an empty table gives
    no rows. Percent must be at least 50.
    """
    classes = jaccard_classes(docs, id_col, text_col, shingle, percent)
    return classes.select("doc_id", "n_shingles", F.nullif("first.rid", F.lit(NULL_ID)).alias("component_id"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, leaf: int | None = None) -> DataFrame:
    """doc_id, rid, h1, h2 (the row's key), n_shingles, first: the smallest row key of the class, of every row; see jaccard_components.

    Rows that share an id but not the text, null ids included, are different members. leaf (None: LEAF) changes the work and no
    result: with wide limits, where many members of a cell are linked, smaller leaves leave more of it to pivots.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    profile = written(known.mapInArrow(lean(_profiles(shingle, percent)), "doc_id long, rid long, h1 long, h2 long, n long, s1 long, s2 long, keys array<long>, cells binary"), "profiles")
    cells = written(_cells(profile), "cells")
    members = cells.select(F.col("x").alias("s1")).distinct().join(profile.where("cells is not null").select("s1", "n", "cells", *ROW_KEY), "s1").dropDuplicates(["s1"])
    members = written(members, "members")
    wanted = members.drop("n", "cells")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_MEMBERS else wanted
    texts = wanted.join(known.select(*ROW_KEY, "text"), list(ROW_KEY)).select("s1", "text").dropDuplicates(["s1"])
    members = written(members.drop(*ROW_KEY).join(texts, "s1"), "texts")
    component, _ = _links(cells, members, shingle, percent, leaf or LEAF)

    # the sums of equal sets are equal, so every row finds its class by them
    sets = profile.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct(*ROW_KEY)).alias("own"))
    sets = sets.join(component.withColumnRenamed("node", "s1"), "s1", "left").withColumn("class", F.coalesce("component", "s1"))
    sets = written(sets.select("s1", "s2", "n", "own", "class"), "sets")
    labels = sets.join(sets.groupBy("class").agg(F.min("own").alias("first")), "class").select("s1", "s2", "n", "first")
    out = profile.drop("keys", "cells").join(labels, ["s1", "s2", "n"], "left")
    return out.select("doc_id", *ROW_KEY, F.col("n").alias("n_shingles"), F.coalesce("first", F.struct(*ROW_KEY)).alias("first"))
