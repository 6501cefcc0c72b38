"""Exact byte-level BPE over cached pre-token units, with the tokenizers library.

A text is cut at every space that a character other than white space follows. There the library's own pattern
always starts a match (a space joins what follows it; white space before it ends its own match), so the ids of a
text are those of its units, one after another. A line end that no white space touches is a match of its own, so a
unit may start there too. Units repeat, so each worker keeps what it has encoded, in two generations of bounded size:
what is used again moves to the younger one, the older is dropped when that is full. Many texts at once are split and
their distinct units found by Arrow, and their ids gathered by numpy; a Python value is made of each distinct unit only.

A unit that is not cached is cut into pre-tokens. Units of plain letters and marks (Latin, whose character classes
no Unicode version disputes) are cut here and each pre-token goes through the library's BPE model, cached too;
any other unit, also one with a special token's string, goes through the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The places where a text is cut: Python's white space holds all that the library's pattern takes as such.
_CUT = re.compile(r" (?=\S)")
_PLAIN = re.compile(r"[\n\x20-\x7e¡-ɏ]*")
#: White space beside a space or line end: such texts are cut at _CUT alone. The second form has all that Python takes as white space, for Arrow.
_UNSAFE = re.compile(r"[ \n]\s|\s\n")
_UNSAFE_RE2 = r"[ \n][\s\v\x1c-\x1f\x85\p{Z}]|[\s\v\x1c-\x1f\x85\p{Z}]\n"
#: Longer units go through the library whole and aren't kept.
_LONG = 256
#: Characters of a piece of a long text, and bytes of texts that are split at once.
_PIECE, _SPLIT_BYTES = 1_000_000, 8_000_000
#: A word and marks after it, each a match of the library's pattern; no apostrophe, which may start one with letters.
_MARKED = re.compile(r"([A-Za-z]+)([!-&(-/:-@\[-`{-~]+)")
_WORD_LIKE = re.compile(r"[^\W\d_]*([!-&(-/:-@\[-`{-~]*|.)", re.S)
_PIECE_END = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(4)
def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 as it is, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Generations(dict):
    """A cache of two generations: make(key) fills it, and at most 2 * limit keys are held."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value


class _Units(Generations):
    """Ids by key of a unit. The usual units, a word with or without one mark after it, are cut here without a further call."""

    def __init__(self, encoder: UnitEncoder, limit: int):
        super().__init__(encoder.encode_key, limit)
        self.tokens, self.model, self.space, self.id_bytes, self.letters, self.line_end = encoder.tokens, encoder.model, encoder.space, encoder.id_bytes, encoder.letters, encoder.line_end
        #: Whether no special token's string can be a word, with marks after it or not.
        self.words_only = not any(_WORD_LIKE.fullmatch(s) for s in encoder.specials)

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            if len(key) >= _LONG:
                return self.make(key)
            if not self.words_only:
                value = self.make(key)
            elif key.isascii():
                if key.isalpha():
                    id_bytes = self.id_bytes
                    value = b"".join([id_bytes[t.id] for t in self.model.tokenize(self.space + key)])
                elif key[:-1].isalpha() and key[-1] != " ":
                    value = self[key[:-1]] + self.tokens[key[-1]]
                elif (m := _MARKED.fullmatch(key)) is not None:
                    value = self[m[1]] + self.tokens[m[2]]
                elif key[:1] == "\n" and key[1:].isalpha():
                    value = self.line_end + self.tokens[key[1:]]
                else:
                    value = self.make(key)
            elif not _PLAIN.fullmatch(key):
                value = self.make(key)
            elif key.isalpha():
                id_bytes = self.id_bytes
                value = b"".join([id_bytes[t.id] for t in self.model.tokenize(self.space + key.encode().decode("latin-1").translate(self.letters))])
            elif key[:-1].isalpha() and key[-1] != " ":
                value = self[key[:-1]] + self.tokens[key[-1]]
            else:
                value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class UnitEncoder:
    """encode(text): its ids as little-endian unsigned 32-bit integers, as the library gives them without added special tokens."""

    def __init__(self, path: str, pattern: str, limit: int = 400_000):
        import regex

        self.library, self.pattern = load_tokenizer(path), regex.compile(pattern)
        self.model = self.library.model
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters, self.space = _byte_letters(), _byte_letters()[32]
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        #: Special tokens' strings with white space in them, and the ids of a line end.
        self.spaced, self.line_end = [x for x in self.specials if re.search(r"\s", x)], self._ids("\n")
        self.tokens = Generations(self.encode_token, limit // 4)
        self.units = _Units(self, limit)

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_token(self, token: str) -> bytes:
        """The ids of one pre-token."""
        if token[0] == " " and token[1:].isalnum() and token.isascii():
            mapped = self.space + token[1:]
        else:
            mapped = token.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(mapped)])

    def encode_unit(self, unit: str) -> bytes:
        """The ids of a stretch between two cuts."""
        if len(unit) > _LONG or not (unit.isascii() or _PLAIN.fullmatch(unit)) or any(s in unit for s in self.specials):
            return self._ids(unit)
        body = unit[1:] if unit[:1] == " " else unit
        if body.isalpha():
            return self.tokens[unit]
        if body[:-1].isalpha() and body[-1] != " ":
            return self.tokens[unit[:-1]] + self.tokens[unit[-1]]
        if not _PLAIN.fullmatch(unit):
            return self._ids(unit)
        return b"".join(map(self.tokens.__getitem__, self.pattern.findall(unit)))

    def encode_key(self, key: str) -> bytes:
        """The key of a unit is what follows its space; one that starts a line has the line end in its key. A text's first unit has a space before its key instead."""
        if key[:1] == " ":
            return self.encode_unit(key[1:])
        if key[:1] == "\n":
            return self.line_end + self.encode_unit(key[1:])
        return self.encode_unit(" " + key)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.spaced):
            return self._ids(text)
        if len(text) > 2 * _PIECE:
            return b"".join(map(self.encode, _pieces(text)))
        if _UNSAFE.search(text):
            first, *rest = _CUT.split(text)
            return b"".join([self.encode_unit(first), *map(self.units.__getitem__, rest)])
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = " " + keys[0]
        return b"".join(map(self.units.__getitem__, keys))

    def split(self, texts: pa.Array) -> Iterator[tuple[int, list[str] | None, np.ndarray | None, np.ndarray | None, list[str]]]:
        """Consecutive texts at a time: (how many, distinct keys, number of each unit's key, where each text's units end, texts to be encoded alone).

        Texts that can't be split here come one at a time, with None for keys.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        alone = pc.match_substring_regex(texts, _UNSAFE_RE2).to_numpy(zero_copy_only=False) | (sizes > _PIECE)
        for s in self.spaced:
            alone |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            if alone[at]:
                yield 1, None, None, None, [texts[at].as_py()]
                at += 1
                continue
            end = at + 1
            total = int(sizes[at])
            while end < len(texts) and not alone[end] and total < _SPLIT_BYTES:
                total += int(sizes[end])
                end += 1
            lists = pc.split_pattern(pc.replace_substring(texts.slice(at, end - at), "\n", " \n"), " ")
            ends = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
            code, ends = coded.indices.to_numpy().astype(np.int64), ends - ends[0]
            words = coded.dictionary.to_pylist()
            code[ends[:-1]] += len(words)
            met = np.zeros(2 * len(words), bool)
            met[code] = True
            distinct = np.flatnonzero(met)
            place = np.cumsum(met) - 1
            yield end - at, [words[c] if c < len(words) else " " + words[c - len(words)] for c in distinct.tolist()], place[code], ends[1:], []
            at = end

    def encode_many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as 32-bit integers."""
        for _, keys, unit, ends, rest in self.split(texts):
            if keys is None:
                yield from (np.frombuffer(self.encode(t), "<u4") for t in rest)
                continue
            pieces = list(map(self.units.__getitem__, keys))
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
            ids, starts = np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(sizes) - sizes
            own = sizes[unit]
            upto = np.cumsum(own)
            stream = ids[np.repeat(starts[unit] - upto + own, own) + np.arange(upto[-1])]
            yield from np.split(stream, upto[ends - 1][:-1])


def _pieces(text: str) -> Iterator[str]:
    """Parts of about _PIECE characters that are cut before spaces that no white space touches."""
    start = 0
    while (m := _PIECE_END.search(text, start + _PIECE)) is not None:
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


@lru_cache(2)
def unit_encoder(path: str, pattern: str) -> UnitEncoder:
    """One for each Python worker, which keeps it from task to task."""
    return UnitEncoder(path, pattern)
