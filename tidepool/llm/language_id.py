"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

A text is the mean of the vectors of its subwords (byte n-grams of each word between word marks, and the word itself),
hashed into a fixed table. Table and softmax are trained by stochastic gradient descent in numpy. Because the softmax is
linear in the mean, the trained table is multiplied out once and scoring adds a few numbers per subword of each distinct
word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm._words import Words, batch_words, lean, mix

BUCKETS, DIMENSIONS, GRAMS = 1 << 15, 16, (2, 3, 4)
#: At most so many labelled documents are used for training; the table is fixed in size, so more add little.
SAMPLE = 3000
UNKNOWN = "und"


def word_buckets(w: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word of each row of this piece as an index of its distinct words, buckets of all subwords, ends of each distinct word)."""
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[first], w.end[first] - w.start[first]
    width = size + 2
    ends = np.cumsum(width)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width)
    own = np.repeat(np.arange(len(first)), width)
    inner = (at > 0) & (at <= size[own])
    text = np.full(len(at), 1, np.uint64)  # the word mark
    raw = w.data[(start[own] + at - 1)[inner]]
    text[inner] = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    found, whose = [(w.hash[first] % np.uint64(buckets)).astype(np.int64)], [np.arange(len(first))]
    for n in GRAMS:
        if len(text) < n:
            continue
        h = np.full(len(text) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + text[k : len(text) - n + 1 + k]
        whole = own[: len(h)] == own[n - 1 :]
        found.append((mix(h[whole]) % np.uint64(buckets)).astype(np.int64))
        whose.append(own[: len(h)][whole])
    found, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return inverse, found[order], np.cumsum(np.bincount(whose, minlength=len(first)))


def _bags(batches):
    """(h, lang, text) -> h, lang, buckets with counts of each text as bytes: at most one entry a bucket however long the text is."""
    seen = set()
    for b in batches:
        rows = [k for k, x in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) if not (x in seen or seen.add(x))]
        b, buckets, counts = b.take(pa.array(rows, pa.int64())), [], []
        for w in batch_words(b.column(2), lower=True):
            inverse, found, ends = word_buckets(w)
            begin = np.append(0, ends[:-1]) if len(ends) else ends
            for d in range(w.docs):
                own, n = np.unique(inverse[w.offsets[d] : w.offsets[d + 1]], return_counts=True)
                bag = np.zeros(BUCKETS, np.int64)
                size = ends[own] - begin[own] if len(own) else own
                flat = np.repeat(begin[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) if len(own) else own
                np.add.at(bag, found[flat], np.repeat(n, size))
                has = np.flatnonzero(bag)
                buckets.append(has.astype("<i4").tobytes())
                counts.append(bag[has].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], names=["h", "lang", "buckets", "counts"])


def _sample(labelled: DataFrame, text_col: str, lang_col: str, sample: int):
    """Bags of the `sample` different labelled texts with the smallest hashes, in that order.

    Hashes below a bound that leaves about twice as many are picked first, without a text; then only those texts are read.
    """
    known = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.xxhash64(text_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = 2 * sample / max(1, known.count())
    while True:
        below = known if share >= 1 else known.where(F.col("h") < F.lit(int(share * 2**64) - 2**63))
        keys = below.groupBy("h", "lang").agg(F.lit(1)).orderBy("h", "lang").limit(sample).select("h", "lang").collect()
        if len(keys) == sample or share >= 1:
            break
        share *= 4
    picked = known.where(F.col("h") <= keys[-1].h) if keys else known.limit(0)
    bags = picked.mapInArrow(lean(_bags), "h long, lang string, buckets binary, counts binary").dropDuplicates(["h", "lang"]).toPandas()
    return bags.sort_values(["h", "lang"]).head(sample)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: embeddings multiplied by the softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scorer(self, keep: list[int]):
        """Batches whose last column is the text -> the columns in `keep`, language, probability."""

        def run(batches):
            for b in batches:
                best, score = [], []
                for w in batch_words(b.column(b.num_columns - 1), lower=True):
                    inverse, found, ends = word_buckets(w)
                    begin = np.append(0, ends[:-1]).astype(np.int64) if len(ends) else ends
                    per_word = np.add.reduceat(self.table[found], begin, axis=0, dtype=np.float64) if len(ends) else np.zeros((0, len(self.languages)))
                    run_ = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(per_word[inverse], 0)])
                    count = np.append(0, np.cumsum((ends - begin)[inverse] if len(ends) else inverse))
                    n = np.maximum(1, count[w.offsets[1:]] - count[w.offsets[:-1]])
                    z = ((run_[w.offsets[1:]] - run_[w.offsets[:-1]]) / n[:, None] + self.bias) / self.temperature
                    p = np.exp(z - z.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best.append(p.argmax(1))
                    score.append(p.max(1))
                names = np.array(self.languages, object)[np.concatenate(best)] if best else []
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(names, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], names=[*(b.schema.names[k] for k in keep), "_lang", "_score"])

        return run


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, epochs: int = 6, rate: float = 4.0, seed: int = 7) -> LanguageModel:
    """Fit on at most `sample` labelled texts (those with the smallest hashes of text). One in five of them sets the
    temperature (least log loss) and the rejection limit (which a thousandth of true texts fall below, 0.5 at most).
    Where no labelled text holds a word, the model has no language; see identify."""
    picked = _sample(labelled, text_col, lang_col, sample)
    picked = picked[picked.buckets.map(len) > 0].reset_index(drop=True)
    if picked.empty:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    languages = sorted(picked.lang.unique())
    y = picked.lang.map(languages.index).to_numpy()
    rng = np.random.default_rng(seed)
    table, weights, bias = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    weights += rng.normal(0, 0.1, weights.shape)
    bags = [(np.frombuffer(i, "<i4"), np.frombuffer(c, "<f4") / np.frombuffer(c, "<f4").sum()) for i, c in zip(picked.buckets, picked.counts, strict=True)]
    held = np.arange(len(bags)) % 5 == 4 if len(bags) >= 50 else np.zeros(len(bags), bool)
    fit = np.flatnonzero(~held)

    def logits(rows):
        return np.array([table[i].T @ c for i, c in (bags[r] for r in rows)]) @ weights + bias

    def softmax(z):
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 16)):
            mean = np.array([table[i].T @ c for i, c in (bags[r] for r in rows)])
            p = softmax(mean @ weights + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ weights.T
            weights -= step * mean.T @ p
            bias -= step * p.sum(0)
            for r, g in zip(rows, back, strict=True):
                i, c = bags[r]
                table[i] -= step * 10 * np.outer(c, g)
    check = np.flatnonzero(held) if held.any() else fit
    z = logits(check)
    loss = {t: -np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-300).mean() for t in np.geomspace(0.05, 5, 40)}
    temperature = min(loss, key=loss.get)
    right = softmax(z / temperature)[np.arange(len(check)), y[check]]
    return LanguageModel(languages, (table @ weights).astype(np.float32), bias, float(temperature), float(min(0.5, np.quantile(right, 0.001))))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, the columns in `carry` (None: the text), lang_pred, score (0 to 1) and accepted of every row.

    Null texts and texts without a letter are `und` with score 0 and not accepted; others are accepted if their score is
    at least the model's rejection limit. A model that had no text to learn from says `und` with score 0 to all and accepts
    every text with a letter. Texts are read whole, whatever their length. Repeated rows and null ids are scored like all
    others; other columns are ignored, and those in `carry` may have any name; an empty table gives no rows.
    """
    known, carry = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)), (text_col,) if carry is None else carry
    # the text goes to Python once, as the last column
    names = {c: f"c{k}" for k, c in enumerate(carry) if c != text_col} | {text_col: "text"}
    rows = docs.select(F.col(id_col).alias("id"), known.alias("known"), *(F.col(c).alias(n) for c, n in names.items()))
    keep = [k for k, n in enumerate(rows.columns) if n != "text" or text_col in carry]
    if model.languages:
        kinds = dict(rows.dtypes)
        rows = rows.mapInArrow(lean(model.scorer(keep)), ", ".join(f"{rows.columns[k]} {kinds[rows.columns[k]]}" for k in keep) + ", _lang string, _score double")
    else:
        rows = rows.withColumns({"_lang": F.lit(UNKNOWN), "_score": F.lit(0.0)})
    lang, score = F.when(F.col("known"), F.col("_lang")).otherwise(UNKNOWN), F.when(F.col("known"), F.col("_score")).otherwise(0.0)
    return rows.select(F.col("id").alias("doc_id"), *(F.col(names[c]).alias(c) for c in carry), lang.alias("lang_pred"), score.alias("score"), (F.col("known") & (F.col("_score") >= model.reject_below)).alias("accepted"))
