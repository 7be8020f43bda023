"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has exactly one last token in its BPE encoding. An automaton gives the tokens that end at
each position; the one that is compatible with the last token of the prefix before it is stored, and the ids follow
from the back-pointers. Text is split as the vocabulary's byte-level pre-tokenizer does; special tokens in a text are
found first. Nulls and empty texts encode to no ids. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import itertools
import json
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, slices
from .cuts import Recent, cut_texts

#: Fixed value: the byte-level pre-tokenizer's split pattern.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks and words in each of two generations, and token pairs (of long words; slots of a table for the rest), that a worker keeps at most.
CHUNKS, WORDS, PAIRS, SLOTS = 300_000, 120_000, 50_000, 1 << 20
#: Bytes of words that are encoded side by side, and how many of them at once; longer words go one by one.
LONGEST, BESIDE = 60, 20_000
#: Texts that are encoded together.
AT_ONCE = 500


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def slot_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """A place among 2^bits for each key."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


class Suffixes:
    """Tokens as a trie read from their last byte, whose edges are kept in exact hash tables: those that find their slot taken go to the next table."""

    def __init__(self, tokens: list[tuple[bytes, int]]):
        edges: dict[int, int] = {}
        ends = {}
        for token, rank in tokens:
            node = 0
            for b in reversed(token):
                node = edges.setdefault(node << 8 | b, len(edges) + 1)
            ends[node] = rank
        self.token = np.full(len(edges) + 1, -1, np.int64)
        self.token[list(ends)] = list(ends.values())
        keys, to = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64)
        self.tables, bits = [], 20
        while len(keys):
            held, node, at = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.int32), slot_of(keys, bits)
            held[at], node[at] = keys, to
            self.tables.append((bits, held, node))
            left = held[at] != keys
            keys, to, bits = keys[left], to[left], bits - 1

    def step(self, nodes: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The nodes reached by one more byte; 0 where there is none."""
        keys = nodes << 8 | by
        out = np.zeros(len(keys), np.int64)
        todo = np.arange(len(keys))
        for bits, held, node in self.tables:
            at = slot_of(keys[todo], bits)
            found = held[at]
            hit = found == keys[todo]
            out[todo[hit]] = node[at[hit]]
            todo = todo[~hit & (found >= 0)]
            if not len(todo):
                break
        return out


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer file. Tokens are handled by rank: bytes first, then merges in order."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, vocab = byte_alphabet(), spec["model"]["vocab"]
        latin = lambda t: "".join(chr(of[c]) for c in t)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        names = [c for c, _ in sorted(of.items(), key=lambda x: x[1])] + [a + b for a, b in merges]
        self.rank = rank = {}
        for k, t in enumerate(names):
            rank.setdefault(t, k)
        self.id_of = np.array([vocab[t] for t in names], dtype=np.uint32)
        self.text = [latin(t) for t in names]
        self.parts = [None] * 256 + [(rank[a], rank[b]) for a, b in merges]
        self.pair = {(x << 20) | y: rank[a + b] for (a, b), (x, y) in zip(merges, self.parts[256:], strict=True)}
        self.right: dict[int, list[int]] = {}
        self.left: dict[int, list[int]] = {}
        self.memo: dict[int, bool] = {}
        self.bytes_of = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for k, t in enumerate(self.text):
            self.bytes_of[self.id_of[k]] = t.encode("latin-1")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, k in self.special.items():
            self.bytes_of[k] = t.encode()
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.marks = {t[0] for t in self.special if t}
        self.plain_split = regex.compile(SPLIT).findall
        self.known = set(map(chr, range(128)))
        self.odd: dict[int, str] = {}
        sound = [True] * len(names)
        for k in range(256, len(names)):
            a, b = self.parts[k]
            sound[k] = sound[a] and sound[b] and rank[names[k]] == k and self.stays_apart(a, b, k)
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.text):
            if sound[k]:
                self.automaton.add_word(t, (k, len(t)))
        self.automaton.make_automaton()
        # a text's bytes are never 255, which parts words
        self.suffixes = Suffixes([(t.encode("latin-1"), k) for k, t in enumerate(self.text) if sound[k] and "\xff" not in t])
        self.apart = np.full(SLOTS, -1, np.int64)
        self.ids = self.id_of.tolist()
        self.chunks, self.words = Recent(CHUNKS, self.make_chunks), Recent(WORDS, self.make_words)
        sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.size_of, self.start_of = sizes, np.cumsum(sizes) - sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)

    def meet(self, texts: Iterable[str]) -> None:
        """Asks the library's pre-tokenizer for the class of code points not met before, and keeps a stand-in for those that this pattern's tables class otherwise.

        The tables of the two are of different versions of Unicode, so letters of one may be symbols of the other.
        """
        new = set().union(*texts) - self.known
        if not new:
            return
        import regex
        from tokenizers import pre_tokenizers

        cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        for c in new:
            if not 0xD800 <= ord(c) < 0xE000:
                spans = [s for _, s in cut(f"a{c}1")]
                theirs = "a" if (0, 2) in spans else "1" if (1, 3) in spans else "!" if len(cut(f"!{c}")) == 1 else "\t"
                ours = "a" if regex.match(r"\p{L}", c) else "1" if regex.match(r"\p{N}", c) else "\t" if regex.match(r"\s", c) else "!"
                if theirs != ours:
                    self.odd[ord(c)] = theirs
        self.known |= new

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text whose code points were met."""
        if not self.odd or text.isascii() or self.odd.keys().isdisjoint(map(ord, text)):
            return self.plain_split(text)
        ends = list(itertools.accumulate(map(len, self.plain_split(text.translate(self.odd)))))
        return [text[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def spine(self, t: int, side: int) -> list[int]:
        """The tokens at one edge of t, from its byte to t itself."""
        kept = self.left if side == 0 else self.right
        found = kept.get(t)
        if found is None:
            p = self.parts[t]
            found = kept[t] = [t] if p is None else [*self.spine(p[side], side), t]
        return found

    def stays_apart(self, a: int, b: int, until: int = 1 << 30) -> bool:
        """True if merging in order of rank up to rank `until` never joins the edge of a with the edge of b.

        Both edges grow from bytes upwards; the pair at the border is merged first if its rank is below that of what
        the left edge grows to next, and not above that of what the right edge grows to next (ties go left to right).
        """
        x, y, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while True:
            up_x = x[i + 1] if i + 1 < len(x) else until
            up_y = y[j + 1] if j + 1 < len(y) else until
            p = self.pair.get((x[i] << 20) | y[j], until)
            if p < up_x and p <= up_y and p < until:
                return False
            if up_x == until and up_y == until:
                return True
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def word(self, w: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 characters of its bytes."""
        n, memo = len(w), self.memo
        last, size = [0] * (n + 1), [0] * (n + 1)
        for end, (t, k) in self.automaton.iter(w):
            e = end + 1
            if size[e]:
                continue
            if k != e:
                both = (last[e - k] << 20) | t
                ok = memo.get(both)
                if ok is None:
                    if len(memo) > PAIRS:
                        memo.clear()
                    ok = memo[both] = self.stays_apart(last[e - k], t)
                if not ok:
                    continue
            last[e] = t
            size[e] = k
        out, ids = [], self.ids
        while n:
            out.append(ids[last[n]])
            n -= size[n]
        return out[::-1]

    def may_meet(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """stays_apart of each two tokens, or True where none comes before. Answers are kept in a table with one place for each slot."""
        keys = before << 20 | after
        at = slot_of(keys, SLOTS.bit_length() - 1)
        held = self.apart[at]
        ok = (held & 1).astype(bool) | (before < 0)
        new = np.nonzero((held >> 1 != keys) & (before >= 0))[0]
        if len(new):
            asked, which = np.unique(keys[new], return_inverse=True)
            answers = np.fromiter((self.stays_apart(k >> 20, k & 0xFFFFF) for k in asked.tolist()), dtype=bool, count=len(asked))
            ok[new] = answers[which]
            self.apart[slot_of(asked, SLOTS.bit_length() - 1)] = asked << 1 | answers
        return ok

    def beside(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of at most LONGEST bytes, as word gives them: all words' prefixes of one length are decided at once."""
        flat = np.frombuffer(b"\xff" + b"\xff".join(words), dtype=np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1  # of each word: the place before its first byte
        length = np.arange(len(flat)) - np.repeat(starts, sizes + 1)  # of the prefix that ends at each place
        # all tokens that end at each place, the longest first
        end = np.nonzero(length)[0]
        node, ends, tokens, spans = np.zeros(len(end), np.int64), [], [], []
        for k in itertools.count():
            node = self.suffixes.step(node, flat[end - k])
            end, node = end[node > 0], node[node > 0]
            if not len(end):
                break
            token = self.suffixes.token[node]
            real = token >= 0
            ends.append(end[real])
            tokens.append(token[real])
            spans.append(np.full(len(ends[-1]), k + 1))
        end, token, span = (np.concatenate(x[::-1]) if x else np.zeros(0, np.int64) for x in (ends, tokens, spans))
        first, number = np.zeros(len(flat), np.int64), np.arange(len(end))
        first[end[::-1]] = number[::-1]
        turn = (length[end] * 2 + (first[end] != number)).astype(np.uint8)
        order = np.argsort(turn, kind="stable")
        cuts = [0, *np.cumsum(np.bincount(turn, minlength=2)).tolist()]
        last, size = np.full(len(flat), -1, np.int64), np.zeros(len(flat), np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some = order[a:b]
            some = some[size[end[some]] == 0]
            if len(some):
                some = some[self.may_meet(last[end[some] - span[some]], token[some])]
                last[end[some]], size[end[some]] = token[some], span[some]
        at, kept = starts + sizes, np.zeros(len(flat), bool)
        while len(at := at[length[at] > 0]):
            kept[at] = True
            at = at - size[at]
        ids, n = self.id_of[last[kept]].astype("<u4").tobytes(), np.cumsum(kept)
        return [ids[a:b] for a, b in zip((n[starts] * 4).tolist(), (n[starts + sizes] * 4).tolist(), strict=True)]

    def make_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        short = [w for w in raw if len(w) <= LONGEST]
        found = iter([x for a in range(0, len(short), BESIDE) for x in self.beside(short[a : a + BESIDE])])
        return [next(found) if len(w) <= LONGEST else array("I", self.word(w.decode("latin-1"))).tobytes() for w in raw]

    def make_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks: a line break and what follows it, or what follows a space, with the space. They are split as one text, as no pre-token crosses them."""
        self.meet(chunks)
        whole = [c if c[0] == "\n" else " " + c for c in chunks]
        parts = self.split("".join(whole))
        ids = list(map(self.words(set(parts)).__getitem__, parts))
        ends = np.cumsum(np.fromiter(map(len, whole), dtype=np.int64, count=len(whole)))
        after = (np.searchsorted(np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))), ends) + 1).tolist()
        return [ids[a] if b == a + 1 else b"".join(ids[a:b]) for a, b in zip([0, *after[:-1]], after, strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. The chunks of all texts are looked up together."""
        pieces: list[list] = []  # of each text: texts without special tokens, and ids of these
        for text in texts:
            own, at = [], 0
            if text and self.at_special and any(m in text for m in self.marks):
                for m in self.at_special.finditer(text):
                    own += [text[at : m.start()], array("I", [self.special[m.group()]]).tobytes()]
                    at = m.end()
            own.append(text[at:] if text else "")
            pieces.append(own)
        cuts, chunks = cut_texts([p for own in pieces for p in own if isinstance(p, str)])
        heads = {c[0] for c in cuts}
        self.meet(heads)
        starts = {h: self.split(h) for h in heads}
        words = self.words(set().union(*starts.values())).__getitem__
        first = {h: b"".join(map(words, p)) for h, p in starts.items()}
        ids, each = self.chunks(chunks).__getitem__, iter(cuts)
        whole = lambda c: first[c[0]] + b"".join(map(ids, c[1:]))
        return [b"".join([p if isinstance(p, bytes) else whole(next(each)) for p in own]) for own in pieces]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        return self.raw(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from one table."""
        sizes = self.size_of[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start_of[ids] - ends + sizes, sizes)
        return self.flat[at].tobytes()


@kept_in_worker
def model(path: str) -> Bpe:
    """One vocabulary for each Python worker."""
    return Bpe(path)


def encode_column(text: Column | str, path: str) -> Column:
    """array<int> of ids; never null."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = model(path)
        parts = [p for some in slices(texts, AT_ONCE) for p in bpe.encode_all(some)]
        sizes = np.fromiter((len(p) // 4 for p in parts), dtype=np.int64, count=len(parts))
        offsets = np.zeros(len(parts) + 1, dtype=np.int32)
        np.cumsum(sizes, out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<u4").view(np.int32)))

    return encode(text)


#: Ids that are decoded together, but for a longer document.
IDS_AT_ONCE = 200_000


def decode_column(ids: Column | str, path: str) -> Column:
    """Text of ids; special tokens stay; bytes that aren't UTF-8 become U+FFFD. Null ids give an empty text."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        bpe, step, a, out = model(path), lists.offsets.to_numpy(), 0, []
        found, valid = lists.values.to_numpy(zero_copy_only=False), lists.is_valid().to_numpy(zero_copy_only=False)
        while a < len(lists):
            b = max(a + 1, int(np.searchsorted(step, step[a] + IDS_AT_ONCE, "right")) - 1)
            part = found[step[a] : step[b]]
            text = bpe.raw(part)
            ends = np.concatenate([[0], np.cumsum(bpe.size_of[part])])[step[a : b + 1] - step[a]].tolist()
            out += [text[i:j].decode("utf-8", "replace") if ok else "" for i, j, ok in zip(ends[:-1], ends[1:], valid[a:b], strict=True)]
            a = b
        return pa.array(out, pa.string())

    return decode(ids)


def bpe_encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a column of ids, in place of one of that name if there is one.

    No shuffle: each task encodes its rows; chunks and words are kept between rows in bounded tables. Null and empty texts
    have no ids, repeated rows are each encoded, an empty table stays empty.
    """
    return df.withColumn(out, encode_column(text, path))


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of ids, in place of a column of that name; null ids give an empty text."""
    return df.withColumn(out, decode_column(ids, path))
