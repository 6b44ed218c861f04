"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are lower-cased and freed of marks at both ends; a shingle is five of them. Windows hold two strides of shingles
and each starts where the one before is half over, so any run of a template's shingles lies inside one window. Bands and
rows are set for each template size so that a window with the least containment that counts misses with a probability
below MISS. A window's minimum can be a template's only if the window holds that shingle, so bands are worked out for windows
that hold a shingle of some template. Every retrieved place is then compared shingle by shingle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm._words import Spans, Words, mix, pieces, words
from tidepool.llm.licenses import LICENSES

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-5
#: Leading bits of a shingle by which those of no template are passed over.
SIEVE = 20
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def bare_words(first: int, data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words without marks at their ends; words of marks alone are left out."""
    text = data.copy()
    for back in (False, True):  # blank marks that stand next to a blank or a text's end
        while True:
            edge = np.zeros(len(text), bool)
            space = (text == 32) | ((text >= 9) & (text <= 13))
            inner = offsets[:-1][offsets[:-1] < offsets[1:]] if not back else offsets[1:][offsets[:-1] < offsets[1:]] - 1
            if back:
                edge[:-1] = space[1:]
            else:
                edge[1:] = space[:-1]
            edge[inner] = True
            edge &= _MARK[text]
            if not edge.any():
                break
            text[edge] = 32
    return words(first, text, offsets, lower=True)


@dataclass
class _Size:
    """Templates of one stride, with their band table."""

    stride: int
    rows: int
    bands: int
    names: list[str]
    shingles: list[np.ndarray]
    salts: np.ndarray
    table: list[dict[int, list[int]]]
    every: np.ndarray  # shingles of all these templates


def _template_shingles(text: str, shingle: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    w = bare_words(0, data, np.array([0, len(data)]))
    if len(w.hash) < shingle:
        raise ValueError(f"a template needs {shingle} words: {text!r}")
    at = np.arange(len(w.hash) - shingle + 1)
    return np.unique(Spans(w.hash).hash(at, at + shingle))


def _sizes(templates: dict[str, str | tuple[str, ...]], shingle: int, containment: float) -> list[_Size]:
    groups: dict[int, list[tuple[str, int]]] = {}
    sets = {(k, n): _template_shingles(t, shingle) for k, own in templates.items() for n, t in enumerate((own,) if isinstance(own, str) else own)}
    for k, v in sets.items():
        groups.setdefault(2 ** max(1, math.ceil(math.log2(len(v)))), []).append(k)
    out = []
    for stride, names in groups.items():
        least = min(math.ceil(containment * len(sets[k])) / (2 * stride + len(sets[k]) - math.ceil(containment * len(sets[k]))) for k in names)
        rows = 1 if least < 0.3 else 2
        bands = math.ceil(math.log(MISS) / math.log(1 - least**rows))
        salts = mix(np.arange(1, rows * bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bands, rows) | np.uint64(1)
        table: list[dict[int, list[int]]] = [{} for _ in range(bands)]
        for t, k in enumerate(names):
            for b in range(bands):
                table[b].setdefault(int(_band(np.array([_light(sets[k], s).min() for s in salts[b]]))), []).append(t)
        out.append(_Size(stride, rows, bands, [k for k, _ in names], [sets[k] for k in names], salts, table, np.unique(np.concatenate([sets[k] for k in names]))))
    return out


def _band(least: np.ndarray) -> np.ndarray:
    """One value of the minima of a band's rows (first axis)."""
    weight = np.uint64(31) ** np.arange(len(least), dtype=np.uint64)
    return (least * weight.reshape(-1, *[1] * (least.ndim - 1))).sum(0, dtype=np.uint64)


def _light(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = x * salt
        y ^= y >> np.uint64(32)
        return y * np.uint64(0xD6E8FEB86659FD93)


def _scan(w: Words, sizes: list[_Size], sieve: np.ndarray, shingle: int, containment: float):
    """(document, name, first word, last word, share of the template) of each match in a piece."""
    n = len(w.hash) - shingle + 1
    if n <= 0:
        return
    at = np.arange(n)
    grams, doc = Spans(w.hash).hash(at, at + shingle), w.doc()
    whole = doc[:n] == doc[shingle - 1 :]
    some = np.flatnonzero(sieve[(grams >> np.uint64(64 - SIEVE)).astype(np.int64)])
    for z in sizes:
        held = some[np.isin(grams[some], z.every)] if len(some) else some
        if not len(held):
            continue
        blocks = -(-n // z.stride) + 1
        padded = np.full(blocks * z.stride, grams[0])
        padded[:n] = grams
        padded = padded.reshape(blocks, z.stride)
        # windows of two blocks that hold a shingle of a template
        at_block = np.unique(held // z.stride)
        windows = np.unique(np.concatenate([at_block, np.maximum(at_block - 1, 0)]))
        windows = windows[windows < blocks - 1]
        text = np.concatenate([padded[windows], padded[windows + 1]], axis=1)
        hits: set[tuple[int, int]] = set()
        for b in range(z.bands):
            values = _band(np.array([_light(text, s).min(1) for s in z.salts[b]]))
            for i, v in zip(windows.tolist(), values.tolist(), strict=True):
                for t in z.table[b].get(v, ()):
                    hits.add((i, t))
        # neighbouring windows of a template are one region
        regions: list[list[int]] = []
        for t, i in sorted((t, i) for i, t in hits):
            if regions and regions[-1][0] == t and i <= regions[-1][2] + 2:
                regions[-1][2] = i
            else:
                regions.append([t, i, i])
        for t, i, j in regions:
            want = z.shingles[t]
            lo, hi = max(0, i * z.stride - len(want)), min(n, (j + 2) * z.stride + len(want))
            places = lo + np.flatnonzero(np.isin(grams[lo:hi], want) & whole[lo:hi])
            # runs of the template's shingles in one text, broken where more than a template's length lies between
            for run in np.split(places, np.flatnonzero((np.diff(places) > len(want)) | (doc[places[1:]] != doc[places[:-1]])) + 1) if len(places) else []:
                while len(run):
                    inside = run[run < run[0] + len(want) + shingle]
                    share = len(np.unique(grams[inside])) / len(want)
                    if share >= containment:
                        base = w.offsets[doc[run[0]]]
                        yield int(doc[run[0]]), z.names[t], int(run[0] - base), int(inside[-1] + shingle - 1 - base), share
                        run = run[len(inside) :]
                    else:
                        run = run[1:]


def _sieve(sizes: list[_Size]) -> np.ndarray:
    """Which leading bits some template's shingle has."""
    sieve = np.zeros(1 << SIEVE, bool)
    for z in sizes:
        sieve[(z.every >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
    return sieve


def scan_licenses(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] = LICENSES, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """Places of templates in texts: doc_id, license, first_word, last_word (word numbers from 0), containment.

    templates: license -> its wording, or several; each wording is a template of its own. A match holds at least `containment` of
    the template's distinct shingles within a template's length. Matches of different wordings may overlap, each is a row.
    Null, empty and short texts match nothing; texts are scanned whole, whatever their length; repeated rows and null ids are
    scanned like all others; other columns are ignored; an empty table gives no rows. Templates need `shingle` words at least.
    """
    sizes = _sizes(templates, shingle, containment)
    sieve = _sieve(sizes)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            out = []
            for piece in pieces(b.column(1)):
                w = bare_words(*piece)
                out += [(w.first + d, *x) for d, *x in _scan(w, sizes, sieve, shingle, containment)]
            rows, names, lo, hi, share = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "license", "first_word", "last_word", "containment"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, license string, first_word long, last_word long, containment double")
