"""Whole texts to token ids by the ``tokenizers`` library, which is asked once for each word a worker or a batch meets."""

from __future__ import annotations

import os
import string
import sys
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers, in two generations of half as many: bounds its memory, not what it encodes.
REMEMBERED = 500_000
#: Below this character, letters are letters, and lower-cased one by one, in every Unicode version; beyond it the library decides.
PLAIN = "İ"
#: A piece of a mark, a word of such letters and ASCII signs.
_LETTERS, _SIGNS = "".join(c for c in map(chr, range(ord(PLAIN))) if c.isalpha()), "".join("\\" + c for c in string.punctuation)
COMMON = rf"\A(?P<mark>[\x00\n]?)(?P<word>[{_LETTERS}]+)(?P<tail>[{_SIGNS}]*)\z"
#: Words that the library is asked for at a time.
TOGETHER = 200


def plain(word: str) -> bool:
    return word.isascii() or max(word) < PLAIN


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class _Irregular(Exception):
    """White space that a token may span: the whole text goes through the library at once."""


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies have for each byte: itself, or the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ragged:
    """Lists of ids, one after another, and their lengths."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes.astype(np.int64)

    @classmethod
    def of(cls, lists: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(lists), "<u4"), np.fromiter((len(x) // 4 for x in lists), np.int64, len(lists)))

    def pick(self, numbers: np.ndarray) -> Ragged:
        """The lists of these numbers in this order."""
        sizes = self.sizes[numbers]
        at = np.repeat((np.cumsum(self.sizes) - self.sizes)[numbers] - np.cumsum(sizes) + sizes, sizes)
        return Ragged(self.ids[at + np.arange(len(at))], sizes)


class WordEncoder(dict):
    """Token ids, as little-endian unsigned 32-bit integers, of texts under one vocabulary file.

    The text is cut only at places that no token spans, so that the ids of the pieces, put together, are those of the
    whole text: for a vocabulary whose tokens may begin with one space ("byte"), before a space or a newline between two
    other characters; for one that drops white space ("word"), at every space. A text with any other white space at a cut
    is encoded whole. The dictionary holds the ids of pieces; a piece is kept without its leading space, the first one of
    a text behind a NUL, the first one of a line behind its newline.
    """

    def __init__(self, path: str, kind: str, remembered: int = REMEMBERED):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind, self.remembered = kind, max(1, remembered // 2)
        self.older: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.newline = self.whole("\n")
        self.alone = Tokenizer(self.model) if kind == "byte" and self._apart() else None
        self.shown = "".join(self.letters[b] for b in range(256))

    def _apart(self) -> bool:
        """Whether words put together behind spaces, or behind newlines, are merged by the model as each by itself.

        So they are if no token goes on from a word into what separates it from the next, or from a newline into a word.
        """
        model, vocabulary = self.model, self.library.get_vocab(with_added_tokens=False)
        if getattr(model, "ignore_merges", True) or model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix:
            return False
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(self.space)]] = True
        number, newline = {letter: b for b, letter in self.letters.items()}, self.letters[10]
        read = lambda token: bytes(map(number.__getitem__, token)).decode(errors="replace")
        ends = {token[:i] for token in vocabulary for i in range(1, len(token)) if token[i] == self.space}
        return all(end[0] == self.space and not read(end)[1:].isalpha() for end in ends) and all(read(t).isspace() for t in vocabulary if newline in t)

    def whole(self, text: str) -> bytes:
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, space: str) -> bytes:
        """A piece that is one word of letters is one step of the model; anything else takes the library's way."""
        if word.isalpha() and plain(word):
            shown = self.space + word if space else word
            if not word.isascii():
                shown = (space + word).encode().decode("latin1").translate(self.letters)
            return packed([t.id for t in self.model.tokenize(shown)])
        return self.whole(space + word)

    def __missing__(self, piece: str) -> bytes:
        if (known := self.older.get(piece)) is not None:
            self[piece] = known
            return known
        if self.kind == "word":
            if len(piece) > 1 and piece[-1] in ",." and piece[-2].isalpha() and piece[-2] < PLAIN:
                ids = self[piece[:-1]] + self[piece[-1]]
            elif not piece.islower() and piece.isalpha() and plain(piece):
                ids = self[piece.lower()] if piece.lower().islower() else self.whole(piece)
            else:
                ids = self._word(piece, "")
        else:
            mark, word = (piece[0], piece[1:]) if piece[:1] in ("\0", "\n") else ("", piece)
            if not word or word[0].isspace() or word[-1].isspace():
                raise _Irregular
            if mark == "\n":
                return self.newline + self["\0" + word]
            if len(word) > 1 and word[-1] in ",." and word[-2].isalpha() and word[-2] < PLAIN:
                ids = self[mark + word[:-1]] + self["\0" + word[-1]]
            else:
                ids = self._word(word, "" if mark else " ")
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        if self.kind == "word":
            return text.replace("\n", " ").split(" ")
        first, *lines = text.split("\n")
        out = first.split(" ")
        out[0] = "\0" + out[0]
        for line in lines:
            more = line.split(" ")
            more[0] = "\n" + more[0]
            out += more
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "\0" in text:
            return self.whole(text)
        try:
            return b"".join(map(self.__getitem__, self.pieces(text)))
        except _Irregular:
            return self.whole(text)


    def _together(self, words: pa.Array, separator: str) -> Ragged:
        """The ids of words, all behind a space (and with it) or all behind a newline (and without it)."""
        chunks = pa.ListArray.from_arrays(pa.array([*range(0, len(words), TOGETHER), len(words)], pa.int32()), words)
        joined = [charmap_decode((separator + chunk).encode(), "strict", self.shown)[0] for chunk in pc.binary_join(chunks, separator).to_pylist()]
        found = [np.array(e.ids, "<u4") for e in self.alone.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, "<u4"), *found])
        starts = np.flatnonzero(self.begins[ids] if separator == " " else ids == np.frombuffer(self.newline, "<u4")[0])
        if len(starts) != len(words):  # a vocabulary without some byte
            ask = (lambda word: self.whole(" " + word)) if separator == " " else self.whole
            return Ragged.of(list(map(ask, words.to_pylist())))
        if separator == "\n":
            ids, starts = np.delete(ids, starts), starts - np.arange(len(starts))
        return Ragged(ids, np.diff(starts, append=len(ids)))

    def _distinct(self, pieces: pa.Array) -> tuple[Ragged, np.ndarray]:
        """The ids of pieces, and which have none; those of a word and perhaps signs by their parts, many words at a time."""
        parts = pc.extract_regex(pieces, COMMON)
        mark, word, tail = (pc.struct_field(parts, [k]) for k in range(3))
        common = parts.is_valid().to_numpy(zero_copy_only=False)
        behind_space = pc.fill_null(pc.equal(mark, ""), False)
        first = pc.if_else(pc.invert(behind_space), word, None).dictionary_encode()
        later = pc.if_else(behind_space, word, None).dictionary_encode()
        tails = tail.dictionary_encode()
        odd = [self._known(piece) for piece in pieces.filter(pa.array(~common)).to_pylist()]
        tables = [
            Ragged.of([b"", self.newline]), self._together(first.dictionary, "\n"), self._together(later.dictionary, " "),
            Ragged.of(list(map(self.whole, tails.dictionary.to_pylist()))), Ragged.of([ids or b"" for ids in odd]),
        ]
        at = np.cumsum([0, *[len(t.sizes) for t in tables]]).tolist()
        number = lambda coded: pc.fill_null(coded.indices, 0).to_numpy()
        middle = np.where(behind_space.to_numpy(zero_copy_only=False), at[2] + number(later), at[1] + number(first))
        middle[~common] = at[4] + np.arange(len(odd))
        newline = pc.fill_null(pc.equal(mark, "\n"), False).to_numpy(zero_copy_only=False)
        order = np.stack([newline.astype(np.int64), middle, np.where(common, at[3] + number(tails), 0)], 1)
        table = Ragged(np.concatenate([t.ids for t in tables]), np.concatenate([t.sizes for t in tables]))
        picked, missing = table.pick(order.ravel()), ~common
        missing[missing] = [ids is None for ids in odd]
        return Ragged(picked.ids, picked.sizes.reshape(-1, 3).sum(1)), missing

    def _known(self, piece: str) -> bytes | None:
        """The ids of a piece; none for white space that a token may span."""
        try:
            return self[piece]
        except _Irregular:
            return None

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (null: empty), each with ``end_id`` behind, one after another, and their numbers.

        What ``encode`` gives, but under a "byte" vocabulary each distinct piece of the batch is looked at once, its words
        are asked for together, and ids are put in place by arrays.
        """
        texts, end = pc.fill_null(texts.cast(pa.string()), ""), packed([end_id])
        if self.alone is None or not len(texts):
            out = Ragged.of([self.encode(text) + end for text in texts.to_pylist()])
            return out.ids, out.sizes
        # Behind each text comes a piece of its own; a text with a NUL goes through the library.
        marked = pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), " \0.", "")
        cut = pc.split_pattern(marked, " ")
        coded, starts = cut.flatten().dictionary_encode(), cut.offsets.to_numpy().astype(np.int64)
        numbers, firsts, lasts = coded.indices.to_numpy().copy(), starts[:-1] - starts[0], starts[1:] - starts[0] - 1
        known, missing = self._distinct(coded.dictionary)
        spans = missing[numbers]
        spans[lasts] = False
        whole = np.logical_or.reduceat(spans, firsts) | pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        alone = np.flatnonzero(whole)
        extra = Ragged.of([end, *[self.whole(texts[i].as_py()) for i in alone.tolist()]])
        numbers[lasts] = len(known.sizes)
        if len(alone):
            numbers[firsts[alone]] = len(known.sizes) + 1 + np.arange(len(alone))
            kept = np.repeat(~whole, lasts - firsts + 1)
            kept[firsts] = kept[lasts] = True
            numbers, lasts = numbers[kept], np.cumsum(kept)[lasts] - 1
        out = Ragged(np.concatenate([known.ids, extra.ids]), np.concatenate([known.sizes, extra.sizes])).pick(numbers)
        return out.ids, np.diff(np.cumsum(out.sizes)[lasts], prepend=0)


@lru_cache(maxsize=4)
def word_encoder(path: str, kind: str) -> WordEncoder:
    """One encoder for each vocabulary and Python worker."""
    return WordEncoder(path, kind)
