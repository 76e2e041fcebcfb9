"""Secrets in texts: assignments, access keys, hex strings, and strings that a vocabulary encodes badly."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesage.llm.common import beside, quoted, slices, texts_of

#: The base kinds, in the order in which spans with one start are listed; the method's kind is last.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: A candidate of the method: an unbroken run of at least so many of these characters.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
#: Characters a token below which a candidate counts as random. Prose and code have 3 to 5, random base64 about 1.4.
RATIO = 1.9
#: Digests and identifiers that are no secrets: MD5 to SHA-512, UUIDs, plain numbers, times, dashed or slashed words.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+|(?:[A-Za-z]*[/_=-])+[A-Za-z]*|(?:[A-Za-z]+[/_=-])+[0-9]+)$"
)
#: Parts of a candidate, and what glues them together; digests among them, which end a stretch of parts.
PART = re.compile(r"[A-Za-z0-9]+")
DIGEST = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}))(?![A-Za-z0-9])")
LEAST_RANDOM = 20
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@lru_cache(maxsize=2)
def vocabulary_of(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def several_kinds(text: str) -> bool:
    return any(c.isdigit() for c in text) + any(c.islower() for c in text) + any(c.isupper() for c in text) > 1


def random_string(text: str, encoding, ratio: float = RATIO) -> bool:
    """Low characters per token, two kinds of characters at least, and neither a known digest nor an identifier."""
    return several_kinds(text) and not KNOWN.match(text) and len(text) < ratio * len(encoding.encode_ordinary(text))


def stretches(parts: list[tuple[int, int, float]]) -> list[list[tuple[int, int, float]]]:
    """The stretches of consecutive (start, end, score) whose sums of scores no shorter or longer stretch beats, in linear time.

    These are all maximal scoring subsequences (Ruzzo and Tompa 1999): no stretch begins or ends with parts that lower it.
    """
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum with, first part, part after the last, the nearest entry with less before
    total = 0.0
    for i, (_, _, score) in enumerate(parts):
        before, total = total, total + score
        if score <= 0:
            continue
        with_it, first, j = total, i, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= before:
                j = found[j][4]
            if j < 0 or found[j][1] >= with_it:
                break
            before, _, first, _, before_it = found[j]
            del found[j:]
            j = before_it
        found.append((before, with_it, first, i + 1, j))
    return [parts[first:last] for _, _, first, last, _ in found]


def random_parts(text: str, encoding, ratio: float = RATIO) -> list[tuple[int, int]]:
    """(start, end) of the random strings that names, paths and other readable parts are glued to in ``text``.

    Each part between signs counts the characters that its tokens fall short of ``ratio``. Signs count nothing, so a
    base64 string with signs inside is one stretch. Digests and UUIDs belong to none.
    """
    digests = [m.span() for m in DIGEST.finditer(text)]
    runs: list[list[tuple[int, int, float]]] = [[]]
    at = 0
    for m in PART.finditer(text):
        while at < len(digests) and digests[at][1] <= m.start():
            at += 1
        if at < len(digests) and digests[at][0] <= m.start():
            runs.append([])
        else:
            runs[-1].append((*m.span(), ratio * len(encoding.encode_ordinary(m[0])) - len(m[0])))
    out = []
    for stretch in (s for run in runs for s in stretches(run)):
        # A stretch that is an identifier may still have a random part.
        for start, end in [(stretch[0][0], stretch[-1][1])] if not KNOWN.match(text[stretch[0][0] : stretch[-1][1]]) else [p[:2] for p in stretch if p[2] > 0]:
            end = len(text) if not text[end:].strip("=") else end
            if end - start >= LEAST_RANDOM and several_kinds(text[start:end]) and not KNOWN.match(text[start:end]):
                out.append((start, end))
    return out


def uncovered(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ``spans``, in order of their starts, leave of start to end."""
    out = []
    for a, b in spans:
        if start < min(a, end):
            out.append((start, min(a, end)))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def find_spans(text: str, encoding, ratio: float = RATIO) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind. Of a random string that meets base spans, what they leave."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in WORDS):
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in found)
    for m in CANDIDATE.finditer(text):
        met = [(a, b) for a, b in base if a < m.end() and m.start() < b]
        whole = random_string(m[0], encoding, ratio)
        if whole and not met:
            found.append((3, *m.span()))
            continue
        inside = [(m.start() + a, m.start() + b) for a, b in random_parts(m[0], encoding, ratio)]
        for start, end in inside:
            found += [(3, a, b) for a, b in uncovered(start, end, met) if PART.search(text, a, b)]
    return [(KINDS[kind], start, end) for kind, start, end in sorted(found, key=lambda x: (x[1], x[0], x[2]))]


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """``text`` with ``mask`` in place of each span; overlapping spans are one."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, vocabulary: str, pattern: str, ratio: float = RATIO, text_col: str = "text", mask: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``secret_spans``: array of (kind, start, end), in code points, end exclusive.

    With ``mask``, the text has it in place of the secrets. A null text has no spans and stays null; an empty one has
    none. Row for row, without a shuffle: repeated rows stay, an empty table gives an empty one. A column of ``docs``
    named ``secret_spans`` is replaced.
    """
    kept = beside(docs, ["secret_spans"])
    at = kept.index(text_col)
    rows = docs.select(*[quoted(c) if c != text_col else quoted(c).cast("string").alias(c) for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField("secret_spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        encoding = vocabulary_of(vocabulary, pattern)
        for batch in slices(batches):
            texts = texts_of(batch, text_col)
            spans = [find_spans(text, encoding, ratio) for text in texts]
            columns = list(batch.columns)
            if mask is not None:
                whole = columns[at].is_valid().to_pylist()
                columns[at] = pa.array([masked(t, s, mask) if ok else None for t, s, ok in zip(texts, spans, whole, strict=True)], pa.string())
            found = pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*kept, "secret_spans"])

    return rows.mapInArrow(scan, schema)


def joined(spans, base: bool):
    """kind:start:end, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"] != KINDS[3]) if base else spans
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
