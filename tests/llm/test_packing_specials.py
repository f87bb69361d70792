import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
TEXTS = ["<|startoftext|>", "a b <|endoftext|> c", "x<|endoftext|>y\n<|startoftext|>,<|endoftext|>", " <|endoftext|> ", "<|EndOfText|> <|endoftext", "'ll<|endoftext|>'s \x1c<|endoftext|>", "É<|endoftext|>́ 12<|startoftext|>3"]


def test_special_tokens_as_an_unmodified_tokenizer_reads_them(make_docs):
    import zlib

    library = Tokenizer.from_file(PATH)
    ids = [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]
    coder = packing.WordCoder(PATH, plain_specials=False)
    assert [coder.encode(t) for t in TEXTS] == ids
    got = {r.doc_id: r.ids_crc32 for r in packing.query(make_docs(TEXTS), PATH).collect()}
    end = np.asarray([1], "<u4").tobytes()
    assert got == {i: zlib.crc32(x + end) for i, x in enumerate(ids)}
