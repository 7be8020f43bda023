"""The classes of all code points are the library's, whatever Unicode version the pattern's own tables have."""

from tokenizers import Tokenizer

from runlens.llm import bpe, queries


def test_every_code_point_before_letters_digits_and_spaces():
    path = queries.tokenizer_path()
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    for a in range(0, len(points), 50_000):
        texts = [f"{c}'t {c}1!{c} a{c}" for c in points[a : a + 50_000]]
        want = library.encode_batch_fast(texts, add_special_tokens=False)
        for text, ids, enc in zip(texts, own.encode_all(texts), want, strict=True):
            assert list(memoryview(ids).cast("I")) == enc.ids, text
    assert own.odd
