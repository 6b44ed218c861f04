import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidepool.llm.packing import pack_documents, plan_places

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_round_trip_and_places(spark):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "Ünï code é <|endoftext|>x \x1c y's ½ 12"), (10_004, "again"), (None, "none"), (10_005, "word " * 5000), (10_006, "x" * 3000)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("length", docs.doc_id)
    got = pack_documents(docs.repartition(4), PATH, keep_ids=True).collect()
    texts = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s : s + 2048], "<u4").tobytes()
            texts[(r.doc_id, k, s, len(part) // 4, zlib.crc32(part), part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == texts
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.02 * total / 2048 + 1
    assert pack_documents(docs.limit(0), PATH).collect() == []


def test_plan_gives_every_rank_one_place():
    rng = random.Random(4)
    for _ in range(50):
        counts = {rng.randrange(1, 65): rng.randrange(1, 400) for _ in range(rng.randrange(1, 40))}
        fill = defaultdict(list)
        ranks = defaultdict(set)
        for size, rank, n, sequence, offset in plan_places(counts, 64):
            for k in range(n):
                assert rank + k not in ranks[size]
                ranks[size].add(rank + k)
                fill[sequence + k].append((offset, size))
        assert {k: len(v) for k, v in ranks.items()} == counts and all(max(v) == counts[k] - 1 for k, v in ranks.items())
        for places in fill.values():
            end = 0
            for offset, size in sorted(places):
                assert offset == end
                end += size
            assert end <= 64
