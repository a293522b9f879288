"""Ids of texts that hold the tokenizer file's added token."""

import random

from millrace.llm import packing
from millrace.llm.common import tokenizer_path


def test_added_tokens_give_the_ids_of_the_library():
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(33)
    library, parts = Tokenizer.from_file(path), ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<|", " ", "  ", "\n", "the", " the", "é", "日", "!", "12", "'s"]
    texts = ["<|endoftext|>", "", "a<|endoftext|>b", " a <|endoftext|> b ", "<|endoftext|><|endoftext|>", "<|EndOfText|>", "<|endoftext|", "plain words"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    got = packing.byte_bpe(path).encode(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert got[2].tolist()[1] == 50256
