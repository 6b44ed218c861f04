"""Phrase collocations by best-first branch-and-bound growth.

A phrase of two to four words has the score floor(scale * a / (l + r)) of its lowest cut, where a, l and r are the counts of
the phrase, of its first words and of the rest. As the first word occurs f times, no phrase that grows from a prefix with b
occurrences can score more than floor(scale * b / (f + b)): counts only fall along a branch, and the rest occurs at least as
often as the phrase. So the prefixes with the best bounds are grown first, a language's nodes from the bound of its
K-th best on, and what they grow to is known completely from that bound on. A language is settled once as many phrases
survive above it as are asked for (ties included) or nothing is left to grow; the others go on with a larger K.

A phrase is dropped for a longer one that holds it and occurs nearly as often. One word more is enough to look at, as a
phrase between the two occurs at least as often as the longer; words to the right are part of the growth, words to the left
are counted for the phrases that could be reported.

Words are 64-bit hashes of language and word on the way. That no two words share one is verified over the whole
vocabulary, else another seed is taken; phrases are tuples of such words and so exact. Sets of prefixes reach the workers as
bit sets of bounded size, which let through more than the set at worst; what they count is joined exactly afterwards.

Texts are read three times: for words, for pairs of frequent words, and for the runs of words in which every pair is
frequent, a small table on which all growth works.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm._shared import written
from tidepool.llm._words import batch_words, lean, mix

MAX_WORDS, MIN_COUNT, TOP, SCALE, SHARE = 4, 30, 2000, 2_000_000, 80
UNKNOWN = "und"
#: Nodes of a language that the first round grows for each phrase asked for, and the factor of each further round.
FIRST, FURTHER = 4, 8
#: A bit set has 16 bits for each of its members, as far as this many (log2; 16 MB).
MOST_BITS = 27
#: Distinct words that a worker counts, and pairs that it gathers, before it passes them on.
HELD, GATHERED = 200_000, 1 << 19

_MARKS = np.zeros(256, bool)
_MARKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAKS = _MARKS.copy()
_BREAKS[[0x20, 0x09]] = True
#: Shifts of the words of a phrase whose bits make its place in a bit set.
_SHIFTS = (0, 13, 29, 37)


def _hashed(batch: pa.RecordBatch, seed: int):
    """(languages, words, hash of each word, document of each word, whether its piece ends after it) of parts of a batch."""
    languages = [UNKNOWN if x is None else x for x in batch.column(0).to_pylist()]
    salt = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little") for x in set(languages)}
    salts = np.array([salt[x] for x in languages], np.uint64)
    for w in batch_words(batch.column(1), lower=True, space=_BREAKS):
        doc = w.doc()
        h = mix(w.hash ^ salts[w.first + doc])
        h[h == 0] = 1
        marks = np.concatenate([[0], np.cumsum(_MARKS[w.data])])
        ends = np.ones(len(h), bool)
        ends[:-1] = (marks[w.start[1:]] != marks[w.end[:-1]]) | (doc[1:] != doc[:-1])
        yield languages, w, h, doc, ends


def _word_counts(seed: int):
    def run(batches):
        count, text = {}, {}

        def batch():
            names = [text[h] for h in count]
            columns = [pa.array([x for x, _ in names], pa.string()), pa.array([x.decode(errors="replace") for _, x in names], pa.string())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.array(list(count), np.uint64).view(np.int64)), pa.array(list(count.values()), pa.int64())], names=["lang", "word", "h", "n"])

        for b in batches:
            for languages, w, h, doc, _ in _hashed(b, seed):
                found, at, n = np.unique(h, return_index=True, return_counts=True)
                raw = memoryview(w.data)
                for x, i, k in zip(found.tolist(), at.tolist(), n.tolist(), strict=True):
                    if x in count:
                        count[x] += k
                    else:
                        count[x] = k
                        text[x] = languages[w.first + doc[i]], raw[w.start[i] : w.end[i]].tobytes().lower()
                if len(count) > HELD:
                    yield batch()
                    count.clear(), text.clear()
        yield batch()

    return run


class BitSet:
    """Places of a set's members among 2^k bits. A member's bit is set; so may be others'."""

    def __init__(self, members: DataFrame, columns: list[str]):
        self.mask = (1 << min(max((16 * members.count()).bit_length(), 15), MOST_BITS)) - 1
        place = F.lit(0).cast("long")
        for c, s in zip(columns, _SHIFTS, strict=False):
            place = place.bitwiseXOR(F.shiftrightunsigned(F.col(c), s))
        place = place.bitwiseAND(F.lit(self.mask)) + 1
        parts = members.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        bits = np.zeros((self.mask + 1) >> 3, np.uint8)
        for part, own in parts.collect():  # at most 2^27 bits
            lo = (part - 1) * 4096
            bits[lo : lo + 4096] = np.frombuffer(own, np.uint8)[: len(bits) - lo]
        self.sent = members.sparkSession.sparkContext.broadcast(bits)

    def has(self, *words: np.ndarray) -> np.ndarray:
        place = np.zeros(len(words[0]), np.uint64)
        for w, s in zip(words, _SHIFTS, strict=False):
            place ^= w >> np.uint64(s)
        place &= np.uint64(self.mask)
        return (self.sent.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _names(size: int) -> list[str]:
    return [f"h{i + 1}" for i in range(size)]


def _counted(parts: list[list[np.ndarray]], size: int) -> pa.RecordBatch:
    """Equal tuples of words with their number."""
    columns = [np.concatenate([p[i] for p in parts]) for i in range(size)]
    key = columns[0].copy()
    for c in columns[1:]:
        key = mix(key) ^ c
    order = np.argsort(key)
    columns = [c[order] for c in columns]
    # tuples that share a key by chance only stand apart
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([*(pa.array(c[at].view(np.int64)) for c in columns), pa.array(np.diff(np.append(at, len(order))))], names=[*_names(size), "a"])


def _gathered(found, size: int):
    """Batches of counted tuples from an iterator of lists of columns."""
    parts, n = [], 0
    for part in found:
        if len(part[0]):
            parts.append(part)
            n += len(part[0])
        if n >= GATHERED:
            yield _counted(parts, size)
            parts, n = [], 0
    if parts:
        yield _counted(parts, size)


def _pairs(seed: int, frequent: BitSet):
    def found(batches):
        for b in batches:
            for _, _, h, _, ends in _hashed(b, seed):
                known = frequent.has(h)
                at = np.flatnonzero(known[:-1] & known[1:] & ~ends[:-1])
                yield [h[at], h[at + 1]]

    return lambda batches: _gathered(found(batches), 2)


def _runs(seed: int, pairs: BitSet):
    def run(batches):
        for b in batches:
            for _, _, h, _, ends in _hashed(b, seed):
                if len(h) < 3:
                    continue
                linked = np.concatenate([[False], ~ends[:-1] & pairs.has(h[:-1], h[1:]), [False]])
                turn = np.flatnonzero(linked[1:] != linked[:-1])
                first, last = turn[::2], turn[1::2] + 1  # words of a run
                first, last = first[last - first > 2], last[last - first > 2]
                sizes = last - first + 1
                at = np.cumsum(sizes) - sizes
                out = np.zeros(int(sizes.sum()), np.uint64)  # a zero after each run
                inside = np.repeat(at, sizes - 1) + np.arange(int((sizes - 1).sum())) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1)
                out[inside] = h[inside - np.repeat(at - first, sizes - 1)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out.view(np.int64)))], names=["words"])

    return run


def _grams(runs: DataFrame, size: int, grown: BitSet | None = None, held: BitSet | None = None, named: BitSet | None = None) -> DataFrame:
    """Counts of phrases of this size in the runs that grow from a prefix in grown, end in a phrase of held, or are in named."""

    def found(batches):
        for b in batches:
            for row in b.column(0):
                h = row.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if len(h) < size:
                    continue
                words = [h[i : len(h) - size + 1 + i] for i in range(size)]
                take = np.zeros(len(words[0]), bool)
                for bits, own in ((grown, words[:-1]), (held, words[1:]), (named, words)):
                    if bits is not None:
                        take |= bits.has(*own)
                take &= np.all([w != 0 for w in words], axis=0)
                at = np.flatnonzero(take)
                yield [w[at] for w in words]

    names = _names(size)
    out = runs.mapInArrow(lean(lambda batches: _gathered(found(batches), size)), ", ".join(f"{x} long" for x in [*names, "a"]))
    return out.groupBy(*names).agg(F.sum("a").alias("a"))


def _score(a: str, *shares: str) -> Column:
    """floor(scale * a / sum of shares) without overflow."""
    total = sum((F.col(c).cast("decimal(19,0)") for c in shares[1:]), F.col(shares[0]).cast("decimal(19,0)"))
    return F.call_function("div", F.col(a).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(8,0)"), total)


def _lowest(a: str, cuts: list[tuple[str, str]]) -> Column:
    """score, l and r of the lowest cut, the smallest of equal ones."""
    return F.array_min(F.array(*(F.struct(_score(a, x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate(cuts))))


def _nearly(longer: str, a: str) -> Column:
    """Whether the longer phrase occurs nearly as often."""
    return F.col(longer).cast("decimal(19,0)") * 100 >= F.col(a).cast("decimal(19,0)") * SHARE


def _limits(nodes: DataFrame, wanted: int) -> dict[str, int]:
    """For each language a bound that at least so many nodes reach, or 0 where there are not so many."""
    step = SCALE // 2000
    out: dict[str, int] = {}
    have: dict[str, int] = {}
    # at most a thousand rows for each language
    for r in sorted(nodes.groupBy("lang", F.expr(f"bound div {step}").alias("part")).count().collect(), key=lambda r: -r["part"]):
        out.setdefault(r["lang"], 0)
        if have.get(r["lang"], 0) < wanted <= have.get(r["lang"], 0) + r["count"]:
            out[r["lang"]] = r["part"] * step
        have[r["lang"]] = have.get(r["lang"], 0) + r["count"]
    return out


def _longest(df: DataFrame, size: int, name: str) -> DataFrame:
    """The largest count of a phrase with one word more, for each phrase of this size."""
    names = _names(size)
    both = [df.select(*(F.col(x).alias(y) for x, y in zip(_names(size + 1)[i:], names, strict=False)), "a") for i in (0, 1)]
    return both[0].unionByName(both[1]).groupBy(*names).agg(F.max("a").alias(name))


def _grow(pairs: DataFrame, runs: DataFrame, limits: DataFrame, min_count: int) -> DataFrame:
    """Surviving phrases of the languages of limits (lang, limit) that score at least the limit: lang, h1 to h4, a, l, r, score."""
    two = pairs.join(limits, "lang")
    reported = two.where("score >= limit")
    three = _grams(runs, 3, grown=BitSet(two.where("bound >= limit"), _names(2)), held=BitSet(reported, _names(2))).where(F.col("a") >= min_count)
    first = two.select("h1", "h2", "lang", "limit", F.col("f1"), F.col("a").alias("f12"))
    last = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
    three = three.join(first, ["h1", "h2"]).join(last, ["h2", "h3"]).withColumn("low", _lowest("a", [("f1", "f23"), ("f12", "f3")]))
    three = written(three.withColumn("bound", _score("a", "f1", "a")), "three")
    reported3 = three.where("low.score >= limit")
    four = _grams(runs, 4, grown=BitSet(three.where("bound >= limit"), _names(3)), held=BitSet(reported3, _names(3))).where(F.col("a") >= min_count)
    four = written(four, "four")
    first = three.select("h1", "h2", "h3", "lang", "limit", "f1", "f12", F.col("a").alias("f123"))
    last = pairs.select(F.col("h1").alias("h3"), F.col("h2").alias("h4"), F.col("a").alias("f34"), F.col("f2").alias("f4"))
    grown = four.join(first, ["h1", "h2", "h3"]).join(last, ["h3", "h4"])
    # all that the third count, of the last three words, can add is a lower score
    grown = written(grown.where(F.least(_score("a", "f1", "a"), _score("a", "f12", "f34"), _score("a", "f123", "f4")) >= F.col("limit")), "grown")
    wanted = grown.select(*(F.col(x).alias(y) for x, y in zip(_names(4)[1:], _names(3), strict=False))).distinct()
    rest = _grams(runs, 3, named=BitSet(wanted, _names(3))).select(*(F.col(x).alias(y) for x, y in zip(_names(3), _names(4)[1:], strict=False)), F.col("a").alias("f234"))
    grown = grown.join(rest, ["h2", "h3", "h4"]).withColumn("low", _lowest("a", [("f1", "f234"), ("f12", "f34"), ("f123", "f4")])).where("low.score >= limit")
    reported = reported.join(_longest(three.select(*_names(3), "a"), 2, "longer"), _names(2), "left").where(~F.coalesce(_nearly("longer", "a"), F.lit(False)))
    reported3 = reported3.join(_longest(four, 3, "longer"), _names(3), "left").where(~F.coalesce(_nearly("longer", "a"), F.lit(False)))
    none = F.lit(None).cast("long")
    same = [F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score")]
    out = reported.select("lang", "h1", "h2", none.alias("h3"), none.alias("h4"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    return out.unionByName(reported3.select("lang", "h1", "h2", "h3", none.alias("h4"), "a", *same)).unionByName(grown.select("lang", *_names(4), "a", *same))


def _vocabulary(texts: DataFrame) -> tuple[DataFrame, int]:
    """lang, word, h, n of all words, and the seed by which no two words share h."""
    seed = 0
    while True:
        counts = texts.mapInArrow(lean(_word_counts(seed)), "lang string, word string, h long, n long")
        words = written(counts.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "vocabulary")
        if words.groupBy("h").count().where("count > 1").isEmpty():
            return words, seed
        seed += 1


_RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, min_count: int = MIN_COUNT) -> DataFrame:
    """Each language's first top phrases by score (falling), count (falling) and phrase: lang, rank, phrase, a, l, r, n, score.

    Words are runs of characters other than space and tab within pieces between .,;:!? and \\x0A-\\x0D, with A-Z
    lower-cased; phrases have two to four words, lie within a piece and occur min_count times or more. n counts the words of
    the language. Phrases that a longer one with 80 % of their count or more holds are dropped.

    A null language is `und`. Null and empty texts have no words; repeated rows count each; equal scores are ranked by
    count, then by the phrase's UTF-8 bytes. Very long texts are read whole. Other columns are ignored; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).cast("string"), F.col(text_col))
    words, seed = _vocabulary(texts)
    frequent = words.where(F.col("n") >= min_count)
    counts = texts.mapInArrow(lean(_pairs(seed, BitSet(frequent, ["h"]))), "h1 long, h2 long, a long")
    counts = counts.groupBy("h1", "h2").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    one = [frequent.select(F.col("h").alias(f"h{i}"), F.col("n").alias(f"f{i}"), *(["lang"] if i == 1 else [])) for i in (1, 2)]
    pairs = counts.join(one[0], "h1").join(one[1], "h2").withColumn("score", _score("a", "f1", "f2")).withColumn("bound", _score("a", "f1", "a"))
    pairs = written(pairs, "pairs")
    runs = written(texts.mapInArrow(lean(_runs(seed, BitSet(pairs, _names(2)))), "words array<long>"), "runs")
    parts, wanted, open_ = [], FIRST * top, pairs
    while limits := _limits(open_, wanted):
        found = written(_grow(pairs, runs, spark.createDataFrame(list(limits.items()), "lang string, limit long"), min_count), "found")
        have = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
        settled = [x for x, limit in limits.items() if limit == 0 or have.get(x, 0) >= top]
        parts.append(found.where(F.col("lang").isin(settled)))
        open_, wanted = open_.where(~F.col("lang").isin(settled)), wanted * FURTHER
    if not parts:
        return spark.createDataFrame([], _RESULT)
    return _ranked(spark, parts, words, frequent, top)


def _ranked(spark: SparkSession, parts: list[DataFrame], words: DataFrame, frequent: DataFrame, top: int) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    by_score = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    out = out.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place")
    for i, x in enumerate(_names(4)):
        out = out.join(frequent.select(F.col("h").alias(x), F.col("word").alias(f"w{i}")), x, "left")
    out = out.withColumn("phrase", F.concat_ws(" ", *(f"w{i}" for i in range(4))))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")).cast("long")).where(F.col("rank") <= top)
    return out.join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
