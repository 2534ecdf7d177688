"""New words are encoded as they stand in their texts, with nothing put between them."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from sievework.llm.tokenizing import TextEncoder

ODD = [
    None, "", " ", "  ", "a", " a", "a  b", "a \t b", "a\n b \n\n c", "x  y", "  y z", "p  q", "q 　 r", " \u0085s", "it's they'll we 'd '", "café naïve über", "你好 世界 12345 6 78",
    "<|endoftext|> a<|endoftext|>b <| c |> d", "end ", "end  ", "tab\tx\ty ", "\x1f u \x1f", "\U0001f600 \U0001f600‍\U0001f525 éé", "a\r\n b\r c", "\u007f \u007fx \u0001y",
]


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.ids = tokenizer, 0

    def encode(self, *args, **kwargs):
        out = self.tokenizer.encode(*args, **kwargs)
        self.ids += len(out.ids)
        return out

    def encode_batch_fast(self, *args, **kwargs):
        out = self.tokenizer.encode_batch_fast(*args, **kwargs)
        self.ids += sum(len(e.ids) for e in out)
        return out


def _same(encoder, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_odd_texts(name):
    encoder = TextEncoder(public_tokenizers.path(name), kept=50)
    rng = np.random.default_rng(7)
    for _ in range(20):
        # Pieces of odd texts side by side, so that every kind of end meets every kind of beginning.
        _same(encoder, ODD + [" ".join(ODD[i] or "" for i in rng.integers(0, len(ODD), 6)) + "".join(ODD[i] or "" for i in rng.integers(0, len(ODD), 4)) for _ in range(20)])


def test_words_of_a_byte_level_tokenizer_are_encoded_with_nothing_between_them():
    encoder = TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(8)
    words = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 12))) + "é."[: rng.integers(0, 3)] for _ in range(3000)]
    encoder.tokenizer = Counting(encoder.tokenizer)
    ids, _ = encoder.encode(pa.array([" " + " ".join(dict.fromkeys(words))]))
    assert encoder.tokenizer.ids == len(ids)


def test_tokens_that_are_not_the_bytes_of_their_words_part_them_instead():
    encoder = TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.token_bytes = encoder.token_bytes + 1
    _same(encoder, [*ODD, "one two three"])
    assert TextEncoder(public_tokenizers.path("word_bpe_49k.json")).token_bytes is None
