"""Files of token ids: whole texts against the tokenizer, the sequence against its values, places by select."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidepool.llm import token_files as t

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  a  b ", "don't stop,now;it's 3.14!?  \n\n x", "café, été. ×.   y  z   w", "\x1c \x1d\x1c a.\x1f b", "北京 你好。 안녕 , ٣٤", "a\u0085 b　 c᠎ d", "<|endoftext|> x <|endoftext|>", "it 's 'll' !' ' ’s", "\t\tTab\tand\r\nline\n \n\n end \n", "x" * 3000, "é" * 700 + ".", "😀😀 .😀, a😀."]


def whole(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(x or "", add_special_tokens=False).ids + [t.END_ID] for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=700))
def test_sequence(values):
    values = sorted(values)
    s = t.EliasFano(t.EliasFano.encode(np.array(values, np.int64)))
    assert s.values().tolist() == values == [s[i] for i in range(len(s))]
    for x in values[:5]:
        lo, hi = s.find(x)
        assert values[lo:hi] == [x] * values.count(x)


def test_sequence_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 3000, 50_000))
    u, n = int(ends[-1]), len(ends)
    assert len(t.EliasFano.encode(ends)) * 8 < n * (2 + np.log2(u / n) + 0.5)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Zé×.,;!?'\n\t  \x1c\x85  3²字😀́-_s"), max_size=40), min_size=1, max_size=6))
def test_chunks_equal_whole_texts(texts):
    raw = [x.encode() for x in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    ids, sizes = t.encoded(PATH, data, offsets)
    assert [[*x, 2] for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[int(i) for i in x] for x in whole(texts)]


@pytest.mark.parametrize("file_ids", [t.FILE_IDS, 500])
def test_round_trip(spark, tmp_path, file_ids):
    rows = [(i * 3 - 5, x) for i, x in enumerate(TEXTS)] + [(None, "no id"), (None, None), (1, "same id"), (1, "same id"), (1, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as start", "7 as run").repartition(4)
    t.write_token_files(docs, PATH, str(tmp_path / "x"), file_ids=file_ids)
    got = t.read_token_files(spark, str(tmp_path / "x"), keep_ids=True).orderBy("start").collect()
    want = sorted(zip([i for i, _ in rows], whole([x for _, x in rows]), strict=True), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    ids = lambda r: tuple(np.frombuffer(r.ids, "<u4").tolist())
    assert sorted(((r.doc_id or 99, ids(r)) for r in got)) == sorted((i or 99, tuple(x)) for i, x in want)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    found = t.find_documents(spark, str(tmp_path / "x"), [1, None, 77]).collect()
    assert sorted((r.doc_id or 99, tuple(r.ids)) for r in found) == sorted((i or 99, tuple(x)) for i, x in want if i in (1, None))


def test_documents_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in t.token_files(spark.read.parquet(f"{SF}/documents.parquet"), PATH).collect()}
    at = 0
    for r, ids in sorted(zip(docs, whole([r.text for r in docs]), strict=True), key=lambda x: x[0].doc_id):
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_starts_come_from_names_alone(spark, tmp_path):
    t.write_token_files(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), PATH, str(tmp_path / "x"))
    listed = t._listed(spark, str(tmp_path / "x"))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    assert sum(r.n_ids for r in listed.collect()) == 5
