"""Byte-level BPE: encoding by folding ranked merges over the bytes of distinct words, decoding by joining pieces."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesage.functions.binding import let
from tablesage.llm.common import quoted, slices
from tablesage.llm.word_encoding import COMMON, Ragged

#: No rank, and no token: a pair of this rank does not merge, and a pair with this token has this rank.
NEVER = 65_535
#: Two primes; a pair of ids below 65,536 is known by its remainders, since their product exceeds 2^32.
SPREAD, SLOTS = 65_521, 524_287
#: Bits of a place in a list, and of a place and a token's id.
PLACE, TOKEN = 30, 46
#: Longer than any array.
ALL = 1 << 30
#: Bytes of a chunk of a long word, and tokens of a long list whose pieces are joined at a time.
CHUNK, JOINED = 48, 1024
#: The pattern under which letters and signs, each with a space before them, are words.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a task remembers before it starts anew: bounds memory, changes no result.
REMEMBERED = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}


def orderly(ranks: dict[bytes, int]) -> bool:
    """Whether ranks never fall while a text is merged.

    What happens inside the bytes of a token does not depend on what is around them, so it is enough to merge each word
    of the vocabulary.
    """
    for word in ranks:
        parts, last = [word[i : i + 1] for i in range(len(word))], -1
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank < last:
                return False
            if rank == NEVER:
                break
            parts[at : at + 2], last = [parts[at] + parts[at + 1]], rank
    return True


@lru_cache(maxsize=2)
def rank_table(path: str) -> dict[str, list]:
    """The ranks of pairs of ids whose bytes make a word, as arrays of which two are looked at for a pair.

    A pair's slot is (key mod SLOTS + moves[key mod SPREAD]) mod SLOTS with key = left * 65536 + right; the slot holds
    key * 65536 + rank, so one look tells whether the pair merges. Besides, ``first`` has rank * 2^TOKEN + id * 2^PLACE for
    each byte and the byte behind it (256: none), ``words`` the bytes of each id, ``lengths`` their number, and ``orderly`` tells
    whether long words may be merged in chunks. The vocabulary bounds all sizes.
    """
    ranks = read_ranks(path)
    if max(ranks.values()) >= NEVER:
        raise ValueError("vocabularies of up to 65,535 words are supported")
    pairs = {
        (ranks[word[:k]] << 16) + ranks[word[k:]]: rank
        for word, rank in ranks.items() for k in range(1, len(word)) if word[:k] in ranks and word[k:] in ranks
    }
    groups: dict[int, list[int]] = {}
    for key in pairs:
        groups.setdefault(key % SPREAD, []).append(key)
    slots, moves = [-1] * SLOTS, [0] * SPREAD
    for group, keys in sorted(groups.items(), key=lambda x: -len(x[1])):
        draw, move = random.Random(group), 0
        while any(slots[(key % SLOTS + move) % SLOTS] >= 0 for key in keys):
            move = draw.randrange(SLOTS)
        moves[group] = move
        for key in keys:
            slots[(key % SLOTS + move) % SLOTS] = (key << 16) + pairs[key]
    words = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    first = [((ranks.get(bytes([a, b]), NEVER) if b < 256 else NEVER) << TOKEN) + (ranks[bytes([a])] << PLACE) for a in range(256) for b in range(257)]
    return {"moves": moves, "slots": slots, "words": words, "first": first, "lengths": list(map(len, words)), "orderly": [orderly(ranks)]}


def rank_map(spark: SparkSession, path: str) -> Column:
    """The rank table as one constant struct, read once and sent with the tasks; its size is the vocabulary's."""
    known = rank_table(path)
    kinds = {"words": pa.binary(), "slots": pa.int64(), "first": pa.int64(), "orderly": pa.bool_()}
    columns = {name: pa.array([x], pa.list_(kinds.get(name, pa.int32()))) for name, x in known.items()}
    return spark.createDataFrame(pa.table(columns)).select(F.struct(*columns)).scalar()


def encode_words(words: Column, ranks: Column) -> Column:
    """Token ids of each word, given as an array of its bytes: the lowest-ranked pair, leftmost first, merges until none can.

    The fold's state is one number for each token, ``rank * 2^TOKEN + id * 2^PLACE`` with the rank of the token and the next
    one, between two stand-ins for the ends. Pairs of one rank are alike, so with its place added the least number is that of
    the leftmost. A merge changes two of these, so a step looks up two ranks.

    Merging costs the square of the length, so the bytes of a long word are read by chunks: the last tokens read and the
    next chunk are merged anew, and if the first of these tokens comes out again, what is before it stays (tokens are an
    encoding if each two neighbours are; needs ``orderly``). Otherwise more of the last tokens are taken, all in the end.
    The arrays of the rank map are bound once for all words.
    """

    def with_map(moves: Column, slots: Column, first: Column, lengths: Column, orderly: Column) -> Column:
        def looked_up(key: Column) -> Column:
            slot = F.get(slots, ((key % SLOTS + F.get(moves, (key % SPREAD).cast("int"))) % SLOTS).cast("int"))
            # Without its key a slot holds a rank; another key leaves a number above all ranks once its sign is gone.
            rank = F.least((slot - F.shiftleft(key, 16)).bitwiseAND(2**63 - 1), F.lit(NEVER).cast("long"))
            return F.shiftleft(rank, TOKEN) + F.shiftleft(F.shiftright(key, 16), PLACE)

        def merge(state: Column, _step: Column) -> Column:
            # array_position would throw and catch to leave its loop at each find, which costs more than all the rest.
            places = F.transform(state, lambda x, i: x.bitwiseOR(i))

            def at(state: Column, lowest: Column) -> Column:
                new, place = F.shiftright(lowest, TOKEN), lowest.bitwiseAND((1 << PLACE) - 1).cast("int")
                left = F.shiftright(F.get(state, place - 1), PLACE - 16).bitwiseAND(65535 << 16)
                right = F.shiftright(F.get(state, place + 2), PLACE).bitwiseAND(65535)
                keys = F.array(left.bitwiseOR(new), F.shiftleft(new, 16).bitwiseOR(right))
                # Flattening costs less than concatenating; a fold over one number binds it without copying the state.
                return F.flatten(F.array(F.slice(state, 1, place - 1), F.transform(keys, looked_up), F.slice(state, place + 3, ALL)))

            return F.when(F.array_min(state) >= NEVER << TOKEN, state).otherwise(F.aggregate(F.array(F.array_min(places)), state, at))

        def fold(data: Column) -> Column:
            end = F.array(F.lit((NEVER << TOKEN) + (NEVER << PLACE)).cast("long"))
            start = F.transform(data, lambda b, i: F.get(first, b * 257 + F.coalesce(F.get(data, i + 1), F.lit(256))))
            return F.aggregate(data, F.concat(end, start, end), merge, lambda s: F.transform(F.slice(s, 2, F.size(s) - 2), lambda x: F.shiftright(x, PLACE).bitwiseAND(65535).cast("int")))

        def read_on(data: Column, state: Column, chunk: Column, number: Column) -> Column:
            """The state after the next chunk if merging it with the last ``number`` tokens leaves the tokens before as they are."""
            inside = F.size(state["tail"]) > number
            done = F.when(inside, state["done"]).otherwise(F.array().cast("array<array<int>>"))
            tokens = F.when(inside, state["tail"]).otherwise(F.concat(F.flatten(state["done"]), state["tail"]))

            def with_tail(tail: Column) -> Column:
                kept = F.greatest(F.size(tail) - number, F.lit(0))
                behind = F.aggregate(F.slice(tail, kept + 1, ALL), F.lit(0), lambda n, t: n + F.get(lengths, t))
                result = lambda new: F.struct(F.concat(done, F.array(F.slice(tail, 1, kept))).alias("done"), new.alias("tail"))
                window = let(behind, lambda n: F.slice(data, chunk * CHUNK - n + 1, n + CHUNK))
                return let(let(window, fold), lambda new: F.when((kept == 0) | (F.get(new, F.lit(0)) == F.get(tail, kept)), result(new)))

            return let(tokens, with_tail)

        def read(data: Column) -> Column:
            empty = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("tail"))
            numbers = F.transform(F.sequence(F.lit(3), F.lit(30)), lambda e: F.pow(F.lit(2), e).cast("int"))

            def step(state: Column, chunk: Column) -> Column:
                return F.aggregate(numbers, F.when(F.lit(False), state), lambda known, n: F.when(known.isNotNull(), known).otherwise(read_on(data, state, chunk, n)))

            chunks = F.sequence(F.lit(0), ((F.size(data) - 1) / CHUNK).cast("int"))
            return F.aggregate(chunks, empty, step, lambda s: F.concat(F.flatten(s["done"]), s["tail"]))

        return F.transform(words, lambda data: F.when((F.size(data) > 2 * CHUNK) & orderly, read(data)).otherwise(fold(data)))

    names = ("moves", "slots", "first", "lengths")
    return let(ranks[names[0]], lambda a: let(ranks[names[1]], lambda b: let(ranks[names[2]], lambda c: let(ranks[names[3]], lambda d: with_map(a, b, c, d, F.get(ranks["orderly"], F.lit(0)))))))


def decode_ids(ids: Column, ranks: Column) -> Column:
    """The bytes of each list of token ids, joined; long lists by parts, as each join copies what it has."""

    def with_words(words: Column) -> Column:
        def joined(some: Column) -> Column:
            return F.aggregate(some, F.lit(b""), lambda done, i: F.concat(done, F.get(words, i)))

        def by_parts(some: Column) -> Column:
            starts = F.sequence(F.lit(0), ((F.size(some) - 1) / JOINED).cast("int"))
            return F.aggregate(starts, F.lit(b""), lambda done, j: F.concat(done, joined(F.slice(some, j * JOINED + 1, JOINED))))

        return F.transform(ids, lambda one: F.when(F.size(one) <= JOINED, joined(one)).otherwise(by_parts(one)))

    return let(ranks["words"], with_words)


def encode_and_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, and with ``with_ids`` the ids and decoded bytes.

    Three steps within one stage, so nothing is shuffled: the first cuts texts into words by ``pattern``, numbers them and passes
    on, once for a task, the bytes of each word it has not met; higher-order functions encode and decode these; the last puts
    the documents' words together. A null or empty text has no ids. Repeated rows stay; extra columns are left out; an
    empty table gives an empty one. Very long unbroken words are merged by chunks, in time linear in their length, if
    the vocabulary is ``orderly``; with another one it grows with the square.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))

    def cut(batches):
        words: dict[str, int] = defaultdict()
        words.default_factory = words.__len__
        numbered = word_numbers(pattern)
        for batch in slices(batches, 5000, 4_000_000):
            anew = not words or len(words) > REMEMBERED
            if anew:
                words.clear()
            before = len(words)
            numbers, counts = numbered(pc.fill_null(batch.column("text"), ""), words)
            new_words = [word.encode() for word in islice(words, before, None)]
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            ends = np.cumsum([0, *map(len, new_words)]).astype(np.int32)
            data = pa.array(np.frombuffer(b"".join(new_words), np.uint8).astype(np.int32))
            yield pa.record_batch({
                "anew": pa.array([anew]), "doc_ids": one(batch.column("doc_id").to_pylist(), pa.int64()), "counts": one(counts, pa.int32()),
                "numbers": pa.array([numbers.astype(np.int32).tobytes()], pa.binary()),
                "words": pa.ListArray.from_arrays(pa.array([0, len(new_words)], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), data)),
            })

    def join(batches):
        ids_of: list[bytes] = []
        text_of: list[bytes] = []
        for batch in batches:
            for at in range(batch.num_rows):
                if batch.column("anew")[at].as_py():
                    ids_of, text_of = [], []
                ids = batch.column("ids")[at].values
                values, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy().astype(np.int64)
                ends = (4 * (ends - ends[0])).tolist()
                ids_of += [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                text_of += batch.column("decoded")[at].values.to_pylist()
                numbers, start, out = np.frombuffer(batch.column("numbers")[at].as_buffer(), np.int32), 0, []
                for end in batch.column("counts")[at].values.to_numpy().cumsum(dtype=np.int64).tolist():
                    some, start = numbers[start:end].tolist(), end
                    out.append((b"".join(map(ids_of.__getitem__, some)), b"".join(map(text_of.__getitem__, some))))
                columns = {
                    "doc_id": batch.column("doc_ids")[at].values, "n_tokens": pa.array([len(i) // 4 for i, _ in out], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in out]), "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for _, t in out]),
                }
                if with_ids:
                    columns |= {"ids": pa.array([np.frombuffer(i, "<i4") for i, _ in out], pa.list_(pa.int32())), "decoded": pa.array([t for _, t in out], pa.binary())}
                yield pa.record_batch(columns)

    ranks = rank_map(docs.sparkSession, vocabulary)
    blocks = rows.mapInArrow(cut, "anew boolean, doc_ids array<long>, counts array<int>, numbers binary, words array<array<int>>")
    known = blocks.withColumn("ranks", ranks)
    encoded = known.withColumn("ids", encode_words(F.col("words"), F.col("ranks"))).drop("words")
    decoded = encoded.withColumn("decoded", decode_ids(F.col("ids"), F.col("ranks"))).drop("ranks")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")
    return decoded.mapInArrow(join, schema)


def word_numbers(pattern: str) -> Callable[[pa.Array, dict[str, int]], tuple[np.ndarray, np.ndarray]]:
    """A function of texts and of words' numbers (new words get the next) that gives the numbers of the texts' words and how many each has.

    Texts are cut before single spaces and newlines between other characters, where no word of the pattern goes on; those
    with other white space at such a place, or with a NUL, stay whole. Each distinct piece is looked at once: under the
    ``USUAL`` pattern one of a word of letters, and perhaps signs, by Arrow, any other by the pattern itself.
    """
    import regex

    match, usual = regex.compile(pattern).findall, pattern == USUAL

    def distinct(pieces: pa.Array, words: dict[str, int]) -> Ragged:
        never = r"\A(?P<mark>)(?P<word>)(?P<tail>)\b\B"
        parts = pc.extract_regex(pieces, COMMON if usual else never)
        mark, word, tail = (pc.struct_field(parts, [k]) for k in range(3))
        common = parts.is_valid().to_numpy(zero_copy_only=False)

        def numbers(some: pa.Array) -> np.ndarray:
            coded = some.dictionary_encode()
            table = np.array([words[x] if x else -1 for x in [*coded.dictionary.to_pylist(), ""]], np.int64)
            return table[pc.fill_null(coded.indices, -1).to_numpy()]

        lines = pc.if_else(pc.equal(mark, "\n"), "\n", "")
        spaced = pc.binary_join_element_wise(pc.if_else(pc.equal(mark, ""), " ", ""), word, "")
        columns = np.stack([numbers(lines), numbers(spaced), numbers(tail)], 1)[common]
        odd = [[words[x] for x in match(unmarked(piece))] for piece in pieces.filter(pa.array(~common)).to_pylist()]
        table = Ragged(
            np.concatenate([columns.ravel()[columns.ravel() >= 0], np.array([k for one in odd for k in one], np.int64)]),
            np.concatenate([(columns >= 0).sum(1), np.array([len(one) for one in odd], np.int64)]),
        )
        order = np.empty(len(common), np.int64)
        order[common], order[~common] = np.arange(len(columns)), len(columns) + np.arange(len(odd))
        return table.pick(order)

    def numbered(texts: pa.Array, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(texts, rf"[ \n]{{2}}|\A[ \n]|[ \n]\z|[\x00{ODD}]")
        marked = pc.binary_join_element_wise("\0", pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \n"), "")
        cut = pc.split_pattern(marked, " ")
        coded, starts = cut.flatten().dictionary_encode(), cut.offsets.to_numpy().astype(np.int64)
        places, firsts = coded.indices.to_numpy().astype(np.int64), starts[:-1] - starts[0]
        known = distinct(coded.dictionary, words)
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        extra = [[words[x] for x in match(texts[i].as_py())] for i in alone.tolist()]
        places[firsts[alone]] = len(known.sizes) + np.arange(len(alone))
        table = Ragged(np.concatenate([known.ids, np.array([k for one in extra for k in one], np.int64)]), np.concatenate([known.sizes, np.array([len(one) for one in extra], np.int64)]))
        out = table.pick(places)
        return out.ids, np.add.reduceat(out.sizes, firsts) if len(firsts) else np.zeros(0, np.int64)

    return numbered


#: White space besides space and newline, as the pattern's \s has it; and separators that Python counts as such.
ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def unmarked(piece: str) -> str:
    return piece[1:] if piece[0] == "\0" else piece if piece[0] == "\n" else " " + piece
