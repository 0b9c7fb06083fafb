"""``op5_token_ids`` against a tokenizer as the library loads it."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from factloom import llm
from factloom.llm import model_names, tokens
from tests.llm.test_operators import listed


def test_added_tokens_are_the_librarys(spark, tmp_path):
    path = tokens.tokenizer_file(model_names()[0])
    library = Tokenizer.from_file(path)
    texts = ["a plain text", "one <|endoftext|> two", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext |>", "", "last of it"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert library.encode(texts[2], add_special_tokens=False).ids == [library.token_to_id("<|endoftext|>")]
    assert listed(llm.op5_token_ids(spark, str(tmp_path))) == sorted(want, key=repr)
