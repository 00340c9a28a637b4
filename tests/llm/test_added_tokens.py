"""Texts with an added token in another case."""

import pyarrow as pa

from equipoise.llm import packing
from equipoise.llm.queries import tokenizer_path


def test_added_tokens_in_another_case():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["<|ENDOFTEXT|>", "A<|EndOfText|>b.", "Some, TEXT! <|StartOfText|> more.", "<|endoftext|> Und <|ENDOFTEXT|>", "É <|endofTEXT|>É.",
             "<|startoftext|>X", "<|ENDOFTEXT", "plain Text.", None, ""]
    flat, sizes = packing.WordTokenizer(tokenizer_path()).encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        assert flat[at:at + n].tolist() == tok.encode(text or "", add_special_tokens=False).ids, text
        at += n
