"""Names in texts by an automaton over all names: one pass over a text finds each name that stands in it, nested ones too.

The automaton of a shard of names is built in the workers from a list of bounded size; more names are more shards, each of which
passes over the texts. No text is shuffled, and no pair of text and name is made that does not match.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names and characters of a shard, at most; an automaton takes some hundred bytes a character.
SHARD_NAMES, SHARD_CHARS = 100_000, 1 << 20

_BUILT: dict = {}


def _automaton(key, sent, fold):
    """The automaton of a shard, kept for the tasks that follow; its values are the names as they are written."""
    if key not in _BUILT:
        import ahocorasick

        by_key: dict[str, list[str]] = {}
        for name in sent.value:
            by_key.setdefault(fold(name) if fold else name, []).append(name)
        built = ahocorasick.Automaton()
        for folded, own in by_key.items():
            if folded:
                built.add_word(folded, own)
        built.make_automaton()
        _BUILT.clear()
        _BUILT[key] = built
    return _BUILT[key]


def _found(sent, fold, schema: list[str]):
    key = uuid.uuid4().hex

    def run(batches):
        built = _automaton(key, sent, fold)
        for b in batches:
            row, name = [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if text:
                    found = {n for _, own in built.iter(fold(text) if fold else text) for n in own}
                    row += [i] * len(found)
                    name += found
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(row, pa.int64())) for k in range(b.num_columns - 1)), pa.array(name, pa.string())], names=schema)

    return run


def contained(texts: DataFrame, names: DataFrame, text_col: str = "text", fold: Callable[[str], str] | None = str.casefold) -> DataFrame:
    """The columns of texts but its text, and name: once for each name that stands in the text, wherever it stands.

    names: name. fold (None: as written) is applied to both sides, so names that differ in case only are all found. Null and
    empty texts and names match nothing.
    """
    known = names.select("name").where(F.length("name") > 0).distinct()
    count, chars = known.agg(F.count("*"), F.sum(F.length("name"))).first()
    keys = [c for c in texts.columns if c != text_col]
    if not count:
        return texts.select(*keys, F.lit(None).cast("string").alias("name")).where(F.lit(False))
    shards = max(-(-count // SHARD_NAMES), -(-chars // SHARD_CHARS))
    rows = texts.select(*keys, F.col(text_col))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "name string"])
    parts = []
    for s in range(shards):
        own = [r[0] for r in known.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == s).collect()]
        parts.append(rows.mapInArrow(_found(texts.sparkSession.sparkContext.broadcast(own), fold, [*keys, "name"]), schema))
    return reduce(DataFrame.unionByName, parts)
