"""Words in other company (capitals, commas, brackets) are put together of parts that the tokenizer has seen."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidepool.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't DON'T 'start ''s 'x'll'd", "l'été Ça!!'s ÀÉß ÿ a×b ÷ ½x x²", "<|endoftext|>x <|ENDOFTEXT|> a</w> </w>'s</w>", "J̌x İx ſ µ 1234a5", "\x1cq ﻿x \x85y a b", "", " \n\t\x0b\x0c"]


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_parts_are_tokenized_once(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(packing, "_KNOWN", {})
    monkeypatch.setattr(packing, "REMEMBERED", 400)
    words = ["".join(rng.choice("etaoinshéß") for _ in range(rng.randrange(3, 12))) for _ in range(300)]
    odd = ["".join(rng.choice("aAzE'stredvml0 9!-<|>w/_ÀßÖ×÷é~\" \n") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    many = [" ".join(rng.choice(["{}", "({}", "{}),", "{}.", '"{}', "{}!"]).format(rng.choice([w, w.capitalize(), w.upper().replace("SS", "ß")])) for w in rng.choices(words, k=60)) for _ in range(1500)]
    tokenizer = Tokenizer.from_file(PATH)
    known = packing._known(PATH)
    known.tokenizer = Counted(known.tokenizer)
    for texts in (many, ODD + odd, many):
        known.tokenizer.chars = 0
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
        got = {}
        for b in packing._pieces(PATH, 2048, 0, False)([batch]):
            for r in b.to_pylist():
                got.setdefault(r["doc_id"], []).append(r["ids_crc32"])
        want = [[zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())] for t in texts]
        assert [got[i] for i in range(len(texts))] == want
        if texts is many:
            assert known.tokenizer.chars < 2 * sum(len(w) + 1 for w in set(words))
