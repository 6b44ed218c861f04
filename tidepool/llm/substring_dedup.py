"""Substring dedup by relative Lempel-Ziv parsing against an index of all earlier reference blocks.

Every document is cut into blocks: maximal runs of consecutive windows that share their smallest inner phrase
(a phrase of PHRASE words), which is the block's key in the index. A document is parsed against the blocks that come before
it, wherever they stand in the corpus: a block that the index holds is copied from there, and a copy goes on over the next blocks as
long as they follow each other in the same document of reference. That gives factors of place, length and place of
reference. Where blocks of one phrase differ, a copy ends inside the block, so the windows there are checked one by one and
extend the factors at their ends. Greedily, each factor is the one that reaches farthest from where the last one ended.
Together the factors cover exactly the windows whose word sequence starts earlier. Only one row for each block (about a seventh
of the words) is shuffled, and windows only at factor boundaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm._shared import written
from tidepool.llm._words import Spans, batch_words, mix, text_buffers

WINDOW, PHRASE = 20, 8
#: Blocks of one phrase that a batch sends to the phrase's group; phrases with more go to the window check at once.
LOCAL = 8
_JUDGE, _COPY, _CHECK, _MARK = 0, 1, 2, 3
_BLOCKS = "k long, h long, rid long, th long, s0 int, s1 int, st int, rr long, rs int"
_OTHER = 0xA0761D6478BD642F | 1
_NULL_ID = (1 << 63) - 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i; the tail counts as the largest value."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    ahead = lambda y, k: np.concatenate([y[k:], np.full(min(k, len(y)), top)])
    m, have = x, 1
    while have * 2 <= width:
        m = np.minimum(m, ahead(m, have))
        have *= 2
    return m if have == width else np.minimum(m, ahead(m, width - have))


def _blocks(w, window: int, phrase: int):
    """(document, first start, last start, phrase hash, block hash, whether it may repeat itself) of each block of a piece; starts count from the piece."""
    n, doc = len(w.hash), w.doc()
    spans = Spans(w.hash)
    at = np.arange(n)
    fits = at + phrase <= n
    g = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    g[fits] = spans.hash(at[fits], at[fits] + phrase)
    m = _sliding_min(g, window - phrase + 1)
    i = np.flatnonzero(at + window <= w.offsets[1:][doc]) if n else at
    if not len(i):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (m[i[1:]] != m[i[:-1]])
    r0 = i[new]
    r1 = i[np.append(np.flatnonzero(new)[1:] - 1, len(i) - 1)]
    # equal windows inside one block need the phrase at two places of its block
    reach, seen = window - phrase, np.zeros(len(r0), np.int64)
    for t in range(2 * reach + 1):
        seen += (g[np.minimum(r0 + t, n - 1)] == m[r0]) & (r0 + t <= r1 + reach)
    return doc[r0], r0, r1, m[r0], spans.hash(r0, r1 + window), (seen > 1) | (r1 - r0 > reach)


def _block_rows(window: int, phrase: int):
    def run(batches):
        for b in batches:
            rid, th = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            parts = []
            for w in batch_words(b.column(2)):
                doc, r0, r1, a, h, twice = _blocks(w, window, phrase)
                base = w.offsets[doc]
                parts.append((a, h, rid[doc + w.first], th[doc + w.first], r0 - base, r1 - base, twice))
            if not parts:
                continue
            a, h, r, t, s0, s1, twice = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((s0, t, r, h, a))
            a, h, r, t, s0, s1, twice = (x[order] for x in (a, h, r, t, s0, s1, twice))
            st, rr, rs = np.zeros(len(a), np.int32), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
            if len(a):
                same_a = np.append(False, a[1:] == a[:-1])
                lead = np.flatnonzero(~(same_a & np.append(False, h[1:] == h[:-1])))
                lead = np.repeat(lead, np.diff(np.append(lead, len(a))))
                st[(r != r[lead]) | (t != t[lead]) | (s0 != s0[lead])] = _COPY  # this batch has an earlier one
                rr, rs = np.where(st == _COPY, r[lead], 0), np.where(st == _COPY, s0[lead], 0)
                group = np.cumsum(~same_a) - 1
                crowded = (np.bincount(group, st == _JUDGE) > LOCAL)[group] | (np.bincount(group, twice) > 0)[group]
                st[crowded & (st == _JUDGE)] = _CHECK
                marks = a[crowded & ~same_a]
                k = np.where(st == _JUDGE, a, mix(h ^ mix(r.astype(np.uint64) + s0.astype(np.uint64))))
                zero = np.zeros(len(marks), np.int64)
                k, h, r, t = (np.append(x.view(np.int64), y) for x, y in ((k, marks.view(np.int64)), (h, zero), (r, zero), (t, zero)))
                s0, s1, st, rr, rs = np.append(s0, zero), np.append(s1, zero), np.append(st, np.full(len(marks), _MARK, np.int32)), np.append(rr, zero), np.append(rs, zero)
            for i in range(0, len(k) if len(st) else 0, 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000].astype(d)) for x, d in ((k, np.int64), (h, np.int64), (r, np.int64), (t, np.int64), (s0, np.int32), (s1, np.int32), (st, np.int32), (rr, np.int64), (rs, np.int32))], names=["k", "h", "rid", "th", "s0", "s1", "st", "rr", "rs"])

    return run


def _window_rows(window: int):
    """Two hashes, document and start of every window that is to be checked, and its reference where the batch has an earlier one."""

    def run(batches):
        for b in batches:
            rid, th = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            spans, lists = b.column(3).flatten(), b.column(3).offsets.to_numpy()
            f0, f1 = (spans.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if len(lists) and lists[0]:
                lists = lists - lists[0]
            parts = []
            for w in batch_words(b.column(2)):
                out = [[], [], []]
                for d in range(w.docs):
                    row = w.first + d
                    for x, y in zip(f0[lists[row] : lists[row + 1]], f1[lists[row] : lists[row + 1]], strict=True):
                        s = np.arange(x, y + 1)
                        out[0].append(s + w.offsets[d])
                        out[1].append(np.full(len(s), row))
                        out[2].append(s)
                if out[0]:
                    at, row, s = (np.concatenate(x) for x in out)
                    w1, w2 = (Spans(w.hash, base).hash(at, at + window) for base in (_OTHER, _OTHER * 3 % (1 << 64)))
                    parts.append((w1, w2, rid[row], th[row], s))
            if not parts:
                continue
            w1, w2, r, t, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((s, t, r, w2, w1))
            w1, w2, r, t, s = (x[order] for x in (w1, w2, r, t, s))
            lead = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
            lead = np.repeat(lead, np.diff(np.append(lead, len(s))))
            late = (r != r[lead]) | (t != t[lead]) | (s != s[lead])  # this batch has an earlier one
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(r), pa.array(t), pa.array(s.astype(np.int32)), pa.array(late), pa.array(np.where(late, r[lead], 0)), pa.array(np.where(late, s[lead], 0).astype(np.int32))], names=["w1", "w2", "rid", "th", "s", "late", "rr", "rs"])

    return run


def parsed(s0: np.ndarray, s1: np.ndarray, rr: np.ndarray, rs: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, reference, start there) of copied ranges of windows s0..s1, which stand from rs on in document rr:
    ranges that follow each other in one reference are one copy, and from where a factor ends the copy that reaches farthest is next."""
    shift = rs - s0
    order = np.lexsort((s0, shift, rr))
    s0, end, rr, shift = s0[order], s1[order] + window, rr[order], shift[order]
    copies = []
    for a, b, r, d in zip(s0.tolist(), end.tolist(), rr.tolist(), shift.tolist(), strict=True):
        if copies and copies[-1][2:] == [r, d] and a <= copies[-1][1]:
            copies[-1][1] = max(b, copies[-1][1])
        else:
            copies.append([a, b, r, d])
    copies.sort()
    out, at, i, best = [], 0, 0, None
    while i < len(copies) or best is not None:
        while i < len(copies) and copies[i][0] <= at:
            if best is None or copies[i][1] > best[1]:
                best = copies[i]
            i += 1
        if best is None or best[1] <= at:  # nothing goes on from here
            best = None
            if i < len(copies):
                at = max(at, copies[i][0])
            continue
        start = max(at, best[0])
        out.append((start, best[1] - start, best[2], start + best[3]))
        at, best = best[1], None
    return out


def _cut_texts(names: list[str], text: str, window: int, factors: bool):
    """Append n_words, n_removed, kept_text and, if asked for, the factors; the last column holds the ranges of starts to remove."""
    span = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())])

    def run(batches):
        for b in batches:
            column = b.column(names.index(text))
            data, offsets = text_buffers(column)
            raw = data.tobytes()
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            cuts = b.column(len(names))
            ends, has = cuts.offsets.to_numpy(), cuts.is_valid().to_numpy(zero_copy_only=False)
            ends = ends - ends[0]
            flat = cuts.flatten()
            f0, f1, f2, f3 = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            n_words, n_removed, kept, found = [], [], [], []
            for i in range(len(column)):
                own = raw[offsets[i] : offsets[i + 1]].split()
                n_words.append(len(own))
                if has[i] and ends[i + 1] > ends[i]:
                    step = np.zeros(len(own) + window + 1, np.int64)
                    np.add.at(step, f0[ends[i] : ends[i + 1]], 1)
                    np.add.at(step, f1[ends[i] : ends[i + 1]] + window, -1)
                    keep = np.cumsum(step)[: len(own)] == 0
                    own = [x for x, k in zip(own, keep.tolist(), strict=True) if k]
                if factors:
                    part = slice(ends[i], ends[i + 1]) if has[i] else slice(0, 0)
                    found.append([dict(zip(span.names, (s, n, None if r == _NULL_ID else r, q), strict=True)) for s, n, r, q in parsed(f0[part].astype(np.int64), f1[part], f2[part], f3[part], window)])
                n_removed.append(n_words[-1] - len(own))
                kept.append(None if nulls[i] else b" ".join(own).decode())
            more = [pa.array(found, pa.list_(span))] if factors else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), *more], names=[*names, "n_words", "n_removed", "kept_text", *["factors"] * factors])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, factors: bool = False) -> DataFrame:
    """Remove every word that a window of `window` words covers whose word sequence also starts earlier.

    Earlier means a smaller id, or an earlier start in the same document; windows are judged on the input.
    Returns the id and text columns with n_words, n_removed and kept_text (kept words joined by one space). With factors also the
    document's parse: array of (start, length, ref_id, ref_start), words counted from 0, of the copies that cover what goes;
    copies that overlap are cut where the one before ends, so a factor may be shorter than a window.

    Null text: no words, kept_text null. Empty or short texts: nothing removed; texts may have any length. A null id sorts after all others.
    Rows with one id and one text are one document listed twice and get the same result; rows with one id and
    different texts are ordered by a hash of the text. Other columns are ignored, an empty table gives no rows.
    """
    known = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_rid"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"))
    blocks = known.select("_rid", "_th", text_col).mapInArrow(_block_rows(window, phrase), _BLOCKS)
    by_phrase, by_block = Window.partitionBy("k"), Window.partitionBy("k", "h").orderBy("st", "rid", "th", "s0")
    judged = blocks.repartition(F.col("k")).withColumn("_nth", F.rank().over(by_block)).withColumn("_ref", F.first(F.struct("rid", "s0")).over(by_block)).withColumn("_lo", F.min("h").over(by_phrase)).withColumn("_hi", F.max("h").over(by_phrase))
    state = F.when(F.col("st") != _JUDGE, F.col("st")).when(F.col("_nth") > 1, _COPY).when(F.col("_lo") != F.col("_hi"), _CHECK).otherwise(_MARK)
    later = (F.col("st") == _JUDGE) & (F.col("_nth") > 1)
    ref = [F.when(later, F.col(f"_ref.{a}")).otherwise(F.col(b)).alias(b) for a, b in (("rid", "rr"), ("s0", "rs"))]
    found = written(judged.select("rid", "th", "s0", "s1", state.alias("st"), *ref).where(F.col("st") != _MARK), "blocks")

    span = ["s0", "s1", "rr", "rs"]
    of_doc = lambda df: df.groupBy(F.col("rid").alias("_rid"), F.col("th").alias("_th")).agg(F.collect_list(F.struct(*span)).alias("_spans"))
    check = of_doc(found.where(F.col("st") == _CHECK))
    windows = written(known.select("_rid", "_th", text_col).join(check, ["_rid", "_th"]).select("_rid", "_th", text_col, "_spans").mapInArrow(_window_rows(window), "w1 long, w2 long, rid long, th long, s int, late boolean, rr long, rs int"), "windows")
    where = F.struct("rid", "th", "s")
    open_ = windows.where("not late")
    firsts = open_.groupBy("w1", "w2").agg(F.min(where).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("w1", "w2", "_first")
    late = open_.join(firsts, ["w1", "w2"]).where(where > F.col("_first")).select("rid", "th", "s", F.col("_first.rid").alias("rr"), F.col("_first.s").alias("rs"))
    late = late.unionByName(windows.where("late").select("rid", "th", "s", "rr", "rs")).select("rid", "th", F.col("s").alias("s0"), F.col("s").alias("s1"), "rr", "rs")
    cuts = of_doc(found.where(F.col("st") == _COPY).select("rid", "th", *span).unionByName(late))
    names = [id_col, text_col]
    joined = known.join(cuts, ["_rid", "_th"], "left").select(*names, "_spans")
    kinds = dict(docs.dtypes)
    out = f"`{id_col}` {kinds[id_col]}, `{text_col}` string, n_words long, n_removed long, kept_text string"
    return joined.mapInArrow(_cut_texts(names, text_col, window, factors), out + ", factors array<struct<start: int, length: int, ref_id: long, ref_start: int>>" * factors)
