"""Words are encoded side by side: the same ids as the library's, without a loop over each word."""

import random

from tokenizers import Tokenizer

from runlens.llm import bpe
from runlens.llm.queries import tokenizer_path


def test_words_of_usual_length_are_not_encoded_one_by_one(monkeypatch):
    path, rng = tokenizer_path(), random.Random(5)
    kinds = ["abcdefghij", "etaoin ", "ÄéßñøЖж中文🙂", "0123456789", ".,;:!?'\"-_ ", "\t\n  ", "ÿ߿￿"]
    texts = ["", " ", "\n", "a" * 59, *("".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 50))) for _ in range(3000))]
    encoder, library = bpe.Bpe(path), Tokenizer.from_file(path)
    want = [x.ids for x in library.encode_batch(texts + ["b" * 70], add_special_tokens=False)]
    assert [memoryview(x).cast("I").tolist() for x in encoder.encode_all(["b" * 70])] == want[-1:]

    def refused(self, w):
        raise AssertionError(w)

    monkeypatch.setattr(bpe.Bpe, "word", refused)
    for size in (1, 7, 3000):  # the table of pairs is met filled, and words in other company
        got = [memoryview(x).cast("I").tolist() for a in range(0, len(texts), size) for x in encoder.encode_all(texts[a : a + size])]
        assert got == want[:-1]
