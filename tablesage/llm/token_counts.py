"""Token counts by a finite-state transducer compiled from a piece vocabulary."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesage.llm.common import beside, quoted, slices, texts_of

#: What a worker remembers at most before it starts anew; these bound its memory and change no count.
STATES, WORDS, PAIRS = 300_000, 400_000, 400_000
#: Characters of a chunk.
CHUNK = 1 << 14
_SPACE = "▁"
_RESET = re.compile("[^ ](?= )")
_UNIT = re.compile(" +[^ ]*")


class ChunkMap(NamedTuple):
    """What a chunk does to any state: read ``head`` from it, then count ``body`` more and go to ``state``.

    ``head`` is the text before the first place where all states meet (a space behind another character). Without such a
    place the chunk is all head, and ``state`` is None.
    """

    head: str
    body: int
    state: int | None


class Transducer:
    """Deterministic transducer whose transitions carry the change in the number of tokens.

    A state is what later characters can depend on: the longest suffix of the text read that begins some piece, and for
    each place in it the last token of the encoding up to there and the count up to there. Reading a character finds the
    last token of the longer text: the one suffix that is a piece and does not merge with the last token before it; the
    emitted number is the count up to that place, plus one, less the count so far. States are compiled as texts reach
    them. Pieces merge in the order of their scores, higher first and left first; a character outside the vocabulary is
    as many tokens as it has bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        }
        if any(_SPACE in piece.lstrip(_SPACE) for piece in self.scores):
            raise ValueError("pieces that go on behind a space are not supported")
        self.begins = {piece[:k] for piece in self.scores for k in range(1, len(piece))}
        self.longest = max(map(len, self.scores))
        self.apart = lru_cache(PAIRS)(lambda left, right: self.merged(left + right) == [x for x in (left, right) if x])
        self.forget()

    def forget(self) -> None:
        start = ("", ("",), (0,))
        self.numbers, self.states, self.transitions, self.words = {start: 0}, [start], [{}], {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging the best pair again and again: the definition."""
        parts = list(text)
        while len(parts) > 1:
            score, at = max(((self.scores.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if score == float("-inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def step(self, number: int, char: str) -> tuple[int, int]:
        """Compile one transition: the next state and the change in the count."""
        suffix, last, counts = self.states[number]
        text = suffix + char
        for k in range(min(len(text), self.longest), 0, -1):
            token = text[len(text) - k :]
            if (k == 1 or token in self.scores) and self.apart(last[len(text) - k], token):
                break
        change = counts[len(text) - k] + (1 if token in self.scores else len(token.encode()))
        kept = next(n for n in range(len(text), -1, -1) if not n or text[len(text) - n :] in self.begins)
        state = (text[len(text) - kept :], (*last, token)[-kept - 1 :], tuple(c - change for c in (*counts, change)[-kept - 1 :]))
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.transitions.append({})
        self.transitions[number][char] = self.numbers[state], change
        return self.transitions[number][char]

    def run(self, number: int, text: str) -> tuple[int, int]:
        count = 0
        for char in text.replace(" ", _SPACE):
            move = self.transitions[number].get(char) or self.step(number, char)
            number, count = move[0], count + move[1]
        return number, count

    def word(self, word: str) -> int:
        """Tokens of a word behind a space, or behind a newline if it begins with one."""
        count = self.words.get(word)
        if count is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            count = self.words[word] = self.run(0, word if word[:1] == "\n" else " " + word)[1]
        return count

    def chunk(self, text: str) -> ChunkMap:
        reset = _RESET.search(text)
        if reset is None:
            return ChunkMap(text, 0, None)
        rest = text[reset.end() :]
        words = rest[1:].replace("\n", " \n").split(" ")
        if "" in words:  # runs of spaces
            units = _UNIT.findall(rest)
            state, count = self.run(0, units[-1])
            return ChunkMap(text[: reset.end()], count + sum(self.run(0, u)[1] for u in units[:-1]), state)
        known = self.words.get
        counts = list(map(known, words))
        if None in counts:
            counts = list(map(self.word, words))
        state, _ = self.run(0, words[-1] if words[-1][:1] == "\n" else " " + words[-1])
        return ChunkMap(text[: reset.end()], sum(counts), state)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``: associative."""
        if a.state is None:
            return ChunkMap(a.head + b.head, b.body, b.state)
        state, count = self.run(a.state, b.head)
        return ChunkMap(a.head, a.body + count + b.body, state if b.state is None else b.state)

    def count(self, text: str, size: int = CHUNK) -> int:
        if not text:
            return 0
        if len(self.states) >= STATES:
            self.forget()
        text = text.replace(_SPACE, " ")  # the library writes spaces so
        maps = [self.chunk(text[at : at + size]) for at in range(0, len(text), size)]
        while len(maps) > 1:  # neighbours first, as a scan over parallel chunks composes them
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.run(0, " " + maps[0].head)[1] + maps[0].body


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One transducer for each vocabulary and Python worker."""
    return Transducer(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    A null or empty text has no bytes and no tokens. Row for row, without a shuffle: repeated rows stay, an empty table
    gives an empty one. Columns of ``docs`` named as result columns are replaced.
    """
    kept = [c for c in beside(docs, ["n_bytes", "n_tokens", "over_limit"]) if c != text_col]
    hidden = f"_text_{len(docs.columns)}"
    rows = docs.select(*[quoted(c) for c in kept], F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias(hidden)).withColumn("n_bytes", F.octet_length(hidden).cast("long"))

    def count(batches):
        compiled = transducer(vocabulary)
        for batch in slices(batches):
            counts = pa.array([compiled.count(text) for text in texts_of(batch, hidden)], pa.int64())
            names = [*kept, "n_bytes", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], counts], names=names)

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema if f.name != hidden)
    return rows.mapInArrow(count, f"{kinds}, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
