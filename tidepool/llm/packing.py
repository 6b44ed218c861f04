"""Best-fit packing of tokenized documents into sequences by a plan over the length histogram.

Only longer documents than a sequence are cut. The plan works on counts of lengths, of which there are at most as many
as a sequence has places, so the driver holds a bounded table however many documents there are: lengths are taken from
long to short and each goes to the open sequences with the least room that fits. Pieces take the planned places by
their rank within their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm._shared import written
from tidepool.llm._words import lean, text_buffers

SEQUENCE, END_ID = 2048, 0
#: Distinct parts, and distinct words not made of them (about 200 bytes each), that a Python worker remembers the ids of, over all its tasks.
REMEMBERED = 150_000
#: Parts joined by spaces that the tokenizer takes at once.
JOINED = 256
#: What a tokenizer does to a text before its merges, for which PARTS cuts texts of PLAIN as it does. Of these characters (visible ASCII,
#: space, \x09-\x0D and the letters of Latin-1) none composes with another, and each has one lower case of one character.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZERS = [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
PLAIN = re.compile(r"[\x09-\x0D -~À-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0D a-z0-9ß-öø-ÿ]+")


class Remembered(dict):
    """The entries used last, REMEMBERED to twice as many and what a batch adds: an entry goes when it was not asked for in a generation."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def missing(self, keys: set) -> list:
        """Those of keys that are not known; the others are kept for this generation."""
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        new = []
        for k in keys.difference(self):
            v = self.older.get(k)
            if v is None:
                new.append(k)
            else:
                self[k] = v
        return new


class TextIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, for tokenizers whose tokens never span space or \\x09-\\x0D.

    Most different words are few parts in other company (capitals, commas, brackets). Where the tokenizer is known to cut texts
    as PARTS does, only different parts pass through it, many in one text; a text's ids are put together of theirs. Other
    texts are put together of the ids of their words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.words = Remembered(), Remembered()
        told = json.loads(self.tokenizer.to_str())
        model, suffix = told["model"], told["model"].get("end_of_word_suffix")
        steps = (told["normalizer"] or {}).get("normalizers"), (told["pre_tokenizer"] or {}).get("pretokenizers")
        self.cut = steps == (_NORMALIZERS, _PRE_TOKENIZERS) and model["type"] == "BPE" and bool(suffix) and not model["dropout"]
        self.marked = [t["content"] for t in told["added_tokens"]]
        if self.cut:  # tokens that end a part; the suffix is not spelled by a part itself, as no part has both letters and other characters
            self.ends = np.zeros(max([*model["vocab"].values(), *(t["id"] for t in told["added_tokens"])]) + 1, bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: set[str]) -> None:
        new = self.parts.missing(parts)
        for s in range(0, len(new), JOINED):
            part = new[s : s + JOINED]
            ids = np.frombuffer(self._encoded([" ".join(part)])[0], "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(part) and last[-1] == len(ids):
                data, at = ids.tobytes(), [0, *(last * 4).tolist()]
                self.parts.update((p, data[at[k] : at[k + 1]]) for k, p in enumerate(part))
            else:
                self.parts.update(zip(part, self._encoded(part), strict=True))

    def _learn_words(self, words: set[bytes]) -> None:
        new = self.words.missing(words)
        for s in range(0, len(new), 20_000):
            part = new[s : s + 20_000]
            self.words.update(zip(part, self._encoded([w.decode() for w in part]), strict=True))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        plain, other = {}, {}
        for i, raw in enumerate(texts):
            text = raw.decode() if self.cut else ""
            if self.cut and PLAIN.fullmatch(text) and not any(m in text for m in self.marked):
                plain[i] = PARTS.findall(text.lower())
            else:
                other[i] = raw.split()
        self._learn_parts(set().union(*plain.values()))
        self._learn_words(set().union(*other.values()))
        part, word = self.parts.__getitem__, self.words.__getitem__
        return [b"".join(map(part, plain[i])) if i in plain else b"".join(map(word, other[i])) for i in range(len(texts))]


_KNOWN: dict[str, TextIds] = {}


def _known(path: str) -> TextIds:
    if path not in _KNOWN:
        _KNOWN[path] = TextIds(path)
    return _KNOWN[path]


def _pieces(path: str, length: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        known = _known(path)
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            out = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
            for lo in range(0, b.num_rows, 500):
                rows = range(lo, min(lo + 500, b.num_rows))
                for i, ids in zip(rows, known.ids([data[offsets[i] : offsets[i + 1]].tobytes() for i in rows]), strict=True):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[s : s + 4 * length]
                        out["row"].append(i)
                        out["piece"].append(k)
                        out["start"].append(s // 4)
                        out["length"].append(len(part) // 4)
                        out["crc"].append(zlib.crc32(part))
                        if keep_ids:
                            out["ids"].append(part)
            columns = [b.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc"))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out["ids"], pa.binary())] if keep_ids else columns, names=[*names, "ids"] if keep_ids else names)

    return run


def plan_places(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Places (length, first rank, ranks, first sequence, offset): the k-th of these ranks goes to the k-th sequence there.

    Best fit by falling length on counts: sequences with the same room are one entry, so work and result follow the
    number of lengths and not the number of pieces.
    """
    open_, sequences, out = [deque() for _ in range(length + 1)], 0, []
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        for room in range(size, length):
            # a sequence stays the best fit until the size fits no more, so it takes all that go in
            each = room // size
            while left and open_[room]:
                first, n = open_[room].popleft()
                for n_here, fill in ((min(n, left // each), each), (1, left) if left < each else (0, 0)):
                    if n_here and fill:
                        for k in range(fill):
                            out.append((size, rank, n_here, first, length - room + k * size))
                            rank += n_here
                        open_[room - fill * size].append((first, n_here))
                        first, n, left = first + n_here, n - n_here, left - n_here * fill
                if n:
                    open_[room].appendleft((first, n))
        each = length // size
        for n, fill in ((left // each, each), (1, left % each)):
            if n and fill:
                for k in range(fill):
                    out.append((size, rank, n, sequences, k * size))
                    rank += n
                open_[length - fill * size].append((sequences, n))
                sequences += n
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: path of a `tokenizers` file whose pre-tokenizer drops white space. ids_crc32 is the CRC-32 of the piece's ids
    as little-endian unsigned 32-bit numbers; keep_ids adds those bytes as `ids`. Each document ends with end_id.

    Null and empty texts are the end id alone. Repeated rows are packed each. Null ids are kept as they are. Other columns
    are ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    pieces = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(lean(_pieces(tokenizer, length, end_id, keep_ids)), schema), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = docs.sparkSession.createDataFrame(plan_places(counts, length), "length long, first_rank long, ranks long, first_sequence long, offset long")
    # ranks without one task per length: each length is dealt into parts that are numbered by themselves
    parts = max(1, sum(counts.values()) // 20_000)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("part", "before", "nth")
    place = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks"))
    # the plan has at most a few entries for each pair of lengths
    out = ranked.join(F.broadcast(plan.withColumnRenamed("length", "plan_length")), (F.col("length") == F.col("plan_length")) & place)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset"]
    return out.select(*names, *(["ids"] if keep_ids else []))
