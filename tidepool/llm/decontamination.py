"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A seed is a hash of the tokens that a fixed mask selects from a run of tokens; ignored places may hold anything. The two
masks together survive every choice of three substitutions in sixteen tokens; items of fewer tokens are cut into one part
more than the substitutions they may have, of which one is left whole. Seeds of the training texts meet those of
the benchmark, and around each hit the two texts are compared token by token on the hit's diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm._shared import NULL_ID, ROW_KEY, once, row_key, written

MASKS = ((0, 1, 2, 4, 5), (0, 4, 5, 6, 7))
WINDOW, SHARE = 16, 0.8
#: Seeds of the benchmark up to this number (24 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000
_LAST = (1 << 31) - 1


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds(words: str) -> Column:
    """For each mask the seed hashes by place; none where the words are fewer than the mask is wide."""

    def of(n: int, mask: tuple[int, ...]) -> Column:
        last = F.size(words) - (max(mask) + 1)
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(n), *(F.get(words, i + k) for k in mask)))).otherwise(F.array().cast("array<bigint>"))

    return F.array(*(of(n, m) for n, m in enumerate(MASKS)))


def spans(words: str, lengths: list[int]) -> list[Column]:
    """For each length the hashes of all runs of so many words, by place."""

    def of(n: int) -> Column:
        last = F.size(words) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(-1), F.slice(words, i + 1, n)))).otherwise(F.array().cast("array<bigint>"))

    return [of(n) for n in lengths]


def _short_seeds(items: DataFrame, window: int, share: float) -> DataFrame:
    """item, ih, whole, q, n, seed: items shorter than the window cut into one part more than the substitutions that the
    share admits, so that one part is left whole; whole: the item is one part."""
    n = F.size("words")
    parts = (n - F.ceil(F.lit(share) * n) + 1).cast("int")
    at = lambda i: F.floor(i * n / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(at(i).alias("q"), (at(i + 1) - at(i)).alias("n")))
    rows = items.where((n > 0) & (n < window)).select("item", "ih", "words", (parts == 1).alias("whole"), F.explode(cut).alias("x"))
    return rows.select("item", "ih", "whole", "x.q", "x.n", F.xxhash64(F.lit(-1), F.slice("words", F.col("x.q") + 1, F.col("x.n"))).alias("seed"))


def _seed_rows(df: DataFrame, keys: list[str], place: str, lengths: list[int]) -> DataFrame:
    own = F.concat(seeds("words"), F.array(*spans("words", lengths))) if lengths else seeds("words")
    return df.select(*keys, F.explode(own).alias("own")).select(*keys, F.posexplode("own").alias(place, "seed"))


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE, any_length: bool = True) -> DataFrame:
    """Pairs of a document and a benchmark item of which `window` tokens in a row agree in place by at least `share`.

    Items with fewer tokens than the window are their own window. Returns doc_id, item_id, n_matched (tokens of the item
    found in place on the best diagonal), n_tokens (of the item), start (token of the document where the overlap begins).

    Every item shorter than the window is found that the share admits, single tokens included. With any_length=False
    such items are found only where a mask survives, and those with fewer than six tokens never. Null and empty texts
    overlap with nothing. Rows of either table with a null id are compared too (a null id comes back as null); repeated rows
    give one pair, and rows that share an id but not the text one for the id, their best; of diagonals that match equally many
    tokens the one that starts first counts. Texts are read
    whole, whatever their length. Other columns are ignored; empty tables give no rows.
    """
    pairs = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text, window, share, any_length)
    # both in one number, the larger the better, so that the best can be kept before the shuffle
    rank = F.shiftleft(F.col("n_matched").cast("long"), 32) + (_LAST - F.col("start"))
    best = pairs.groupBy("rid", "item").agg(F.max(rank).alias("rank"), F.max("n_tokens").alias("n_tokens"))
    best = best.select("rid", "item", "n_tokens", F.shiftright("rank", 32).alias("n_matched"), (_LAST - F.col("rank").bitwiseAND(F.lit(_LAST))).alias("start"))
    return best.select(F.nullif("rid", F.lit(NULL_ID)).alias("doc_id"), F.nullif("item", F.lit(NULL_ID)).alias("item_id"), F.col("n_matched").cast("long").alias("n_matched"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("start").cast("long").alias("start"))


def overlapping_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE, any_length: bool = True) -> DataFrame:
    """rid, h1, h2: the keys of the rows of docs that overlap with the benchmark, each once."""
    return _overlaps(docs, benchmark, id_col, text_col, item_col, item_text, window, share, any_length).select(*ROW_KEY).distinct()


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, share: float, any_length: bool) -> DataFrame:
    """The row key, item, n_tokens, start and n_matched of each diagonal that counts."""
    key = list(ROW_KEY)
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    known = texts.select(*key, tokens(F.col("text")).alias("words"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(NULL_ID)).alias("item"), tokens(F.col(item_text)).alias("words")).distinct()
    indexed = items.withColumn("ih", F.xxhash64("words"))
    index, lengths = _seed_rows(indexed, ["item", "ih"], "q", []).withColumn("whole", F.lit(False)), []
    if any_length:
        short = _short_seeds(indexed, window, share)
        lengths = sorted(r["n"] for r in short.select("n").distinct().collect())
        index = index.unionByName(short.select("item", "ih", "q", "seed", "whole"))
    if index.count() <= BROADCAST_SEEDS:
        index = F.broadcast(index)
    shift = F.col("p") - F.col("q")
    met = _seed_rows(known, key, "p", lengths).join(index, "seed").select(*key, "item", "ih", shift.alias("shift"), F.when(~F.col("whole"), shift).alias("own"))
    # of an item that is one part, every hit is a full one, so the first will do
    # written, so that Spark knows how many there are and whether the texts need a shuffle to meet them
    hits = written(met.groupBy(*key, "item", "ih", "own").agg(F.min("shift").alias("shift")).drop("own").distinct() if lengths else met.drop("own").distinct(), "hits")
    pairs = hits.join(texts.dropna(subset=["text"]), key).join(items.select("item", F.xxhash64("words").alias("ih"), F.col("words").alias("want")), ["item", "ih"])
    shift, want = F.col("shift"), F.col("want")

    def compared(words: Column) -> Column:
        low, high = F.greatest(F.lit(0), -shift), F.least(F.size(want), F.size(words) - shift)
        same = F.transform(F.sequence(low, high - 1), lambda i: (F.get(want, i) == F.get(words, i + shift)).cast("int"))
        return once(same, lambda x: F.struct((low + shift).alias("start"), F.aggregate(x, F.lit(0), lambda u, v: u + v).alias("n_matched"), densest(x).alias("best")))

    def densest(same: Column) -> Column:
        width = F.least(F.lit(window), F.size(same))
        return F.array_max(F.transform(F.sequence(F.lit(0), F.size(same) - width), lambda s: F.aggregate(F.slice(same, s + 1, width), F.lit(0), lambda x, y: x + y)))

    # a lambda's argument is evaluated once, so a text is cut into tokens once for a hit
    pairs = pairs.select(*key, "item", F.size(want).alias("n_tokens"), once(tokens(F.col("text")), compared).alias("c"))
    pairs = pairs.select(*key, "item", "n_tokens", F.col("c.start").alias("start"), F.col("c.n_matched").alias("n_matched"), F.col("c.best").alias("best"))
    return pairs.where(F.col("best") >= F.ceil(F.lit(share) * F.least(F.lit(window), F.col("n_tokens"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, that have no overlap with the benchmark.

    Columns may have any name. A row goes by its own id and text, so rows with a null or repeated id and another text stay.
    """
    bad = overlapping_rows(docs, benchmark, id_col, text_col, **options).select(F.struct(*ROW_KEY).alias("_bad")).alias("overlapping")
    own = [k.alias(n) for k, n in zip(row_key(id_col, text_col), ROW_KEY, strict=True)]
    return docs.join(bad, F.struct(*own) == F.col("overlapping._bad"), "left_anti")
