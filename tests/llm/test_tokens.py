"""Token files, packing, BPE, counts: against the libraries, on odd texts and on documents."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from tablesage.llm.byte_bpe import encode_and_decode, orderly, read_ranks, word_numbers
from tablesage.llm.common import table
from tablesage.llm.packing import best_fit_runs, pack, sequences, token_pieces
from tablesage.llm.token_counts import Transducer, token_counts
from tablesage.llm.token_files import ids_digest, read_tokens, write_tokens
from tablesage.llm.word_encoding import WordEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a", "th", "er", "The", "Bc", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "é", "ß", "İ", "ς", "Σ", "世", "🙂", "́", "\x1c", " ", "\xa0",
    "1", "23", "<|endoftext|>", "<s>", "</s>", "<unk>", "\0", "-", "ﬁ", "Ⅷ", "ŉ", "aaaa", "▁", "ион", " of",
]


def odd_texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choices(ODD, k=draw.randint(0, 12))) for _ in range(n)]


def packed_ids(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([None, "", "w" * 30_000, *odd_texts(60)])], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(odd)


@pytest.mark.parametrize("path,kind", [(BYTES, "byte"), (WORDS, "word")])
def test_word_encoder_is_the_library(path, kind):
    encoder = WordEncoder(path, kind, remembered=50)
    for text in odd_texts(4000):
        assert encoder.encode(text) == encoder.whole(text), repr(text)


def test_batches_are_encoded_as_by_the_library():
    draw = random.Random(4)
    words = ["the", "Thé", "à", "ª", "Ungö", "naïve", "İz", "日本", "it's", "x1", "a,", "of!!", "é.###", "<s>", "'", "''", "[\\]^-_`", "w" * 3000, "\xa0", "", "\0", "\t"]
    texts = [draw.choice([" ", " ", "\n"]).join(draw.choices(words[: draw.choice([18, 18, len(words)])], k=draw.randint(0, 9))) for _ in range(1500)]
    texts += [None, "", *odd_texts(1500, 7), *["".join(draw.choices("etaoinshrdlu", k=9)) for _ in range(900)]]
    for path, kind in ((BYTES, "byte"), (WORDS, "word")):
        encoder = WordEncoder(path, kind)
        for some in (texts, texts[700:701], ["", None], []):
            ids, sizes = encoder.encode_batch(pa.array(some, pa.string()), 2)
            assert len(ids) == sizes.sum() and len(sizes) == len(some)
            parts = [ids[end - size : end].tobytes() for end, size in zip(np.cumsum(sizes), sizes, strict=True)]
            assert parts == [encoder.whole(t or "") + packed_ids([2]) for t in some]
        if kind == "byte":  # new words are asked for together and not kept one by one
            assert encoder.alone is not None and not any("\0" + text in encoder for text in texts[-900:])


def test_token_files_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(docs.withColumnRenamed("doc_id", "ids").selectExpr("ids", "text", "1 AS part"), path, BYTES, id_col="ids")
    library, at, expected = Tokenizer.from_file(BYTES), 0, []
    for doc_id, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        expected.append((doc_id, at, len(ids), zlib.crc32(packed_ids(ids))))
        at += len(ids)
    assert sorted(map(tuple, ids_digest(read_tokens(spark, path)).collect())) == expected
    one = read_tokens(spark, path, ["doc_id", "n_tokens"]).where("doc_id = 7")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString()


def test_token_files_nulls_ties_and_empty(spark, tmp_path):
    rows = spark.createDataFrame([(None, "x"), (1, "b"), (1, "b"), (1, "a a")], "doc_id long, text string")
    write_tokens(rows, str(tmp_path / "a"), BYTES)
    got = sorted(read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 1] and [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    write_tokens(rows.limit(0), str(tmp_path / "b"), BYTES)
    assert read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_packing(spark, docs):
    got = pack(token_pieces(docs, WORDS, with_ids=True))
    library, expected = Tokenizer.from_file(WORDS), {}
    for row in docs.collect():
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            expected[row.doc_id, at // 2048] = (at, len(ids[at : at + 2048]), zlib.crc32(packed_ids(ids[at : at + 2048])), ids[at : at + 2048])
    rows = got.collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32, r.ids) for r in rows} == expected
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    assert len(placed) <= -(-sum(r.length for r in rows) // 2048) + 2
    assert {r.sequence_id: len(r.ids) for r in sequences(got).collect()} == {s: sum(n for _, n in p) for s, p in placed.items()}
    assert pack(token_pieces(docs.limit(0), WORDS)).count() == 0


def test_best_fit_runs_place_every_piece_once():
    draw = random.Random(3)
    for capacity in (1, 7, 64):
        for _ in range(60):
            counts = {draw.randint(1, capacity): draw.choice([1, 2, 50, 10**9]) for _ in range(draw.randint(0, 6))}
            runs = best_fit_runs(counts, capacity)
            taken = defaultdict(int)
            for length, rank, number, _first, offset in runs:
                assert rank == taken[length] and offset + length <= capacity
                taken[length] += number
            assert taken == counts


def test_words_are_numbered_as_the_pattern_finds_them():
    draw = random.Random(9)
    texts = ["", "a  b", " a", "a\n", "a\n\nb", "x#", "x\x1cy", "\0", *odd_texts(1500), *[f"Wörd's {draw.choice(ODD)}!!\n{draw.choice(ODD)}x, don't A'." for _ in range(200)]]
    for pattern in (public_tokenizers.PATTERN, r"\p{Lu}?\p{Ll}+|\s+|."):  # another one is asked for each distinct piece
        words = defaultdict()
        words.default_factory = words.__len__
        numbers, counts = word_numbers(pattern)(pa.array(texts), words)
        found = [list(words)[k] for k in numbers]
        assert [found[end - n : end] for end, n in zip(np.cumsum(counts), counts, strict=True)] == [regex.findall(pattern, t) for t in texts]


def test_byte_bpe_is_tiktoken(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in encode_and_decode(docs.selectExpr("doc_id", "text", "1 AS words"), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()}
    for row in docs.collect():
        ids, one = library.encode_ordinary(row.text or ""), got[row.doc_id]
        assert one.ids == ids and one.n_tokens == len(ids) and bytes(one.decoded).decode() == (row.text or "")
        assert one.ids_sha256 == hashlib.sha256(packed_ids(ids)).hexdigest() and one.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert len(got) == docs.count()
    assert encode_and_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_long_words_is_tiktoken(spark, tmp_path):
    falling = tmp_path / "falling.tiktoken"
    words = [*[bytes([b]) for b in range(256)], b"abc", b"ab", b"bc", b"ca", b"abca"]
    falling.write_bytes(b"\n".join(base64.b64encode(word) + b" %d" % rank for rank, word in enumerate(words)))
    draw = random.Random(8)
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 400))) for letters in ("ab", "abc", "-=", "etaoin", "éa日") for _ in range(6)]
    texts += ["x" + "a" * n for n in (47, 48, 49, 50, 701)] + ["-" * 1000, "b" + "ha" * 401, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000))]
    for path, some in ((RANKS, texts), (str(falling), [t[:300] for t in texts])):
        ranks = read_ranks(path)
        assert orderly(ranks) == (path == RANKS)
        library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        rows = [(i, t) for i, t in enumerate(some)] * 2  # repeated rows stay
        got = encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN, with_ids=True).collect()
        assert len(got) == len(rows)
        for row in got:
            assert row.ids == library.encode_ordinary(some[row.doc_id]) and bytes(row.decoded).decode() == some[row.doc_id]


def test_transducer_is_the_library():
    library, compiled = sentencepiece.SentencePieceProcessor(model_file=PIECES), Transducer(PIECES)
    draw = random.Random(6)
    for text in odd_texts(2500, 2):
        for size in (1 << 14, draw.randint(1, 9)):
            assert compiled.count(text, size) == len(library.encode(text)), repr(text)


def test_chunk_maps_compose_in_any_order():
    compiled = Transducer(PIECES)
    for text in odd_texts(300, 4):
        a, b, c = (compiled.chunk(t) for t in (text[:3], text[3:7], text[7:])) if len(text) > 7 else (compiled.chunk("a"),) * 3
        one, other = compiled.compose(compiled.compose(a, b), c), compiled.compose(a, compiled.compose(b, c))
        total = lambda m: compiled.run(0, " " + m.head)[1] + m.body
        assert total(one) == total(other)


def test_token_counts(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts(docs.selectExpr("doc_id", "text", "'x' AS N_tokens", "2 AS extra"), PIECES, limit=100)
    assert got.columns == ["doc_id", "extra", "n_bytes", "n_tokens", "over_limit"]
    rows = {r.doc_id: r for r in got.collect()}
    for row in docs.collect():
        text, one = row.text or "", rows[row.doc_id]
        assert (one.n_bytes, one.n_tokens, one.over_limit) == (len(text.encode()), len(library.encode(text)), len(library.encode(text)) > 100)
    assert token_counts(docs.limit(0), PIECES).count() == 0
