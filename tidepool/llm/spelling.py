"""Spelling variants of the words of a corpus by permuterm rotations.

Every word is marked with a terminator and rotated: `wolf$`, `olf$w`, `lf$wo`, ... A rotation without its last character is
what the word shares with every word that has another character there; and it is itself a rotation of the word that lacks
that character. So rotations are sorted by those prefixes, and one scan of each range of equal prefixes sees all words that
a replacement at one place makes of each other, and the one word from which they differ by an insertion. A range holds at
most one word for each letter of the alphabet and that one, so no range is hot however frequent a word is.

The scan gives each word the count and the best of its range, never pairs. A word that repeats a letter reaches the shorter
word from each of them; only the first of equal letters in a row counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm._shared import written
from tidepool.llm._words import lean, text_buffers

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Stands after the last character of a word; no word holds it.
END = "$"
#: Distinct words that a worker counts before it passes them on.
HELD = 200_000
#: Bytes of one text that are searched at once; texts are cut at spaces.
SLICE = 1 << 22
#: Rotations of longer words are compared by two hashes in place of their characters.
LONG = 64


def _slices(text: bytes):
    lo = 0
    while len(text) - lo > SLICE:
        hi = text.find(b" ", lo + SLICE)
        if hi < 0:
            break
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _counts(min_length: int, noise: int | None):
    run_of = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")

    def run(batches):
        total = Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            data, offsets = text_buffers(b.column(1))
            ends = offsets.tolist()
            for k, doc in enumerate(b.column(0).to_pylist()):
                seed = zlib.crc32(b"" if doc is None else str(doc).encode(), 0)
                seed = zlib.crc32(b":", seed)
                for part in _slices(data[ends[k] : ends[k + 1]].tobytes()):
                    runs = Counter(run_of.findall(part.lower().decode(errors="replace")))
                    if noise is None:
                        total.update(runs)
                        continue
                    for w, n in runs.items():
                        h = zlib.crc32(w.encode(), seed)
                        if h % noise == 0:
                            cut = h % len(w)
                            w = w[:cut] + w[cut + 1 :]
                            if len(w) < min_length:
                                continue
                        total[w] += n
                if len(total) > HELD:
                    yield batch()
                    total.clear()
        yield batch()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int | None = None) -> DataFrame:
    """Words of at least min_length code points and min_count occurrences with their number n.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. noise, if given, plants misspellings: a run
    loses one code point where the unsigned CRC-32 h of `<id>:<run>` is divisible by noise, at h modulo its length; a null id
    is written as nothing.
    """
    runs = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(lean(_counts(min_length, noise)), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _key(rotation: Column, length: Column) -> Column:
    """What stands for a rotation, or for one without its last character, of this length."""
    return F.when(length <= LONG, rotation).otherwise(F.concat_ws(":", length.cast("string"), F.sha2(rotation, 256)))


def rotations(words: DataFrame) -> DataFrame:
    """key, rank, kind for every rotation of every word: as it is (kind 0) and without its last character, where kind 1 is
    the first of equal letters in a row and kind 2 a later one. words: rank, word."""
    marked = F.concat("word", F.lit(END))
    turned = words.select("rank", "word", F.length("word").alias("length"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("turn"))
    turned = turned.withColumn("rotation", F.concat(F.substring(marked, F.col("turn") + 1, F.col("length") + 1), F.substring("word", F.lit(1), F.col("turn"))))
    edited = F.substring("word", F.col("turn"), F.lit(1)) == F.when(F.col("turn") > 1, F.substring("word", F.col("turn") - 1, F.lit(1))).otherwise(F.lit(""))
    whole = F.struct(_key(F.col("rotation"), F.col("length") + 1).alias("key"), F.lit(0).alias("kind"))
    open_ = F.struct(_key(F.substring("rotation", F.lit(1), F.col("length")), F.col("length")).alias("key"), F.when(edited, 2).otherwise(1).alias("kind"))
    # the first rotation ends in the terminator, which is not edited
    return turned.select("rank", F.inline(F.when(F.col("turn") == 0, F.array(whole)).otherwise(F.array(whole, open_)))).select("key", "rank", "kind")


def neighbours(words: DataFrame) -> DataFrame:
    """rank, n_near and best (the smallest rank) of the near words of each word that has one. words: rank, word."""
    ranges = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rotations(words).select(
        "rank", "kind", F.count("*").over(ranges).alias("size"), F.count_if(F.col("kind") == 1).over(ranges).alias("first_of_row"), F.count_if(F.col("kind") == 0).over(ranges).alias("shorter"),
        F.first("rank").over(ranges).alias("least"), F.nth_value("rank", 2).over(ranges).alias("next"),
    ).where("size > 1")
    longer = F.col("size") - F.col("shorter")
    near = F.when(F.col("kind") == 0, F.col("first_of_row")).otherwise(longer - 1 + F.when(F.col("kind") == 1, F.col("shorter")).otherwise(0))
    best = F.when(F.col("rank") == F.col("least"), F.col("next")).otherwise(F.col("least"))
    return seen.groupBy("rank").agg(F.sum(near).alias("n_near"), F.min(best).alias("best"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int | None = None) -> DataFrame:
    """Words with the word they are a variant of: word, form, root, n, n_near, form_n.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of
    largest n (ties: the smallest in code-point order) if that n is at least ratio times the word's, else null; root is the
    last word that forms lead to. Counts at least multiply by ratio (2 or more) along forms, so that they have no cycles.

    Null and empty texts have no words; repeated rows count each; equal words are one. Very long texts are searched in slices,
    very long words are compared by hashes of their rotations. Other columns are ignored; an empty table gives no rows.
    """
    counted = word_counts(docs, id_col, text_col, min_length, min_count, noise)
    # ids that grow along the sort: a smaller rank is a better form
    words = written(counted.orderBy(F.col("n").desc(), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "words")
    most = words.agg(F.max("n")).first()[0]
    best = words.join(neighbours(words), "rank", "left")
    forms = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = written(best.join(forms, "best", "left").withColumn("up", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("best"))), "forms")
    steps = found.where("up is not null").select("rank", "up")
    # each round doubles the steps that up stands for; there are at most log(most) of them
    for _ in range(math.ceil(math.log2(max(1.0, math.log(max(most or 1, 1), ratio)))) + 1):
        ahead = steps.select(F.col("rank").alias("up"), F.col("up").alias("further"))
        steps = written(steps.join(ahead, "up", "left").select("rank", F.coalesce("further", "up").alias("up")), "steps")
    roots = steps.join(words.select(F.col("rank").alias("up"), F.col("word").alias("root")), "up").select("rank", "root")
    near = F.col("up").isNotNull()
    out = found.join(roots, "rank", "left")
    return out.select("word", F.when(near, F.col("form")).alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(near, F.col("form_n")).alias("form_n"))
