"""Token ids of chunks against those of whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from tarifa.llm import packing
from tarifa.llm.tokens import BYTE_BPE, WORD_BPE, ChunkEncoder, tokenizer_path

WHITE = [chr(c) for c in range(0x110000) if chr(c).isspace()] + ["᠎", "​", "⁠", "﻿"]
CONTROL = [chr(c) for c in (*range(32), *range(0x7F, 0xA1))]
PARTS = ["hello", "world", "don't", "I'll", "x1", "12345", "naïve", "東京", "😀", "--", "̈", "ΑΣ", "<|endoftext|>", "<|startoftext|>", "<|end", "İ", "'s", "  ", "\n\n", " \n", "\n  ", "\xa0\xa0"]


@pytest.mark.parametrize(("name", "spaced"), [(BYTE_BPE, True), (WORD_BPE, False)])
def test_chunks_have_the_ids_of_whole_texts(name, spaced):
    r = random.Random(7)
    kinds = [PARTS, PARTS, [" "], [" "], ["\n"], WHITE, CONTROL, [chr(c) for c in range(32, 0x3000)]]
    texts = ["hello \xa0 world", "\xa0 one", *("".join(r.choice(r.choice(kinds)) for _ in range(r.randrange(30))) for _ in range(20_000))]
    coder, whole = ChunkEncoder(tokenizer_path(name), spaced, max_chunks=5000, group_chars=2000), Tokenizer.from_file(tokenizer_path(name))
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_of_no_break_spaces(spark):
    whole = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    texts = ["hello \xa0 world", "\xa0 one"] * 20
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert sum(r.length for r in out) == sum(len(whole.encode(t).ids) + 1 for t in texts)


def test_a_repeated_chunk_is_looked_up_once_and_odd_texts_keep_their_ids():
    from collections import defaultdict

    from tarifa.llm import tokens

    class Counted(defaultdict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    for name, spaced in ((tokens.WORD_BPE, False), (tokens.BYTE_BPE, True)):
        coder = tokens.ChunkEncoder(tokens.tokenizer_path(name), spaced)
        coder.known = Counted(None)
        coder.known.default_factory = coder.known.__len__
        Counted.asked = 0
        texts = ["red blue\nred blue"] * 50 + [None, "", " ", " red ", "red  blue", "\tred\x0b é", f"red {coder.special[0]} blue" if coder.special else "x", "blue\n"]
        got = [ids.tolist() for ids in coder.encode(texts)]
        assert Counted.asked < 40
        assert got == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_dictionaries_of_words_and_chunks_go_at_once():
    import gc
    from collections import defaultdict

    import pyarrow as pa

    from tarifa.llm import tokens
    from tarifa.llm.lm_scoring import Block
    from tarifa.llm.shingle_sets import shingle_keys

    large = lambda: sum(isinstance(x, defaultdict) and len(x) > 900 for x in gc.get_objects())
    text = " ".join(f"word{i}" for i in range(1000))
    tokens.release()
    gc.collect()
    before = large()
    gc.disable()
    try:
        for _ in range(3):
            shingle_keys([text], 5)
            Block(pa.chunked_array([[text]]))
            list(tokens.encoder(tokens.tokenizer_path(WORD_BPE), False, max_chunks=990).encode([text]))
            tokens.release()
        assert large() == before
    finally:
        gc.enable()


def test_plain_chunks_are_encoded_by_pieces():
    coder, r = ChunkEncoder(tokenizer_path(WORD_BPE), False), random.Random(3)
    latin = [c for c in map(chr, range(0x21, 0x180)) if not c.isspace()]
    chunks = ["Einzuch.", "###x1,y22;", "don't", "İx", "ŉ", "ª", "x×y", "ſt", "<|endof", "KÅẞ", *("".join(r.choice(latin) for _ in range(r.randrange(1, 9))) for _ in range(20_000))]
    assert len(coder._of_pieces(["Red,", "red.", "red", "12!", "don't"])[0]) == 4
    for chunk, ids in zip(chunks, coder.encode(chunks), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(chunk, add_special_tokens=False).ids, repr(chunk)
