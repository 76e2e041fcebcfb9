"""Best-fit packing of token sequences, in bulk-synchronous steps over classes of equal size."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesage.llm.common import materialize, quoted, slices, texts_of
from tablesage.llm.word_encoding import word_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 0, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece of at most ``longest`` tokens: doc_id, piece, start, length, ids_crc32 (and the ids).

    A document's ids end with ``end_id``; a null or empty text has that id only. Only documents longer than ``longest``
    are cut. Extra columns are left out; repeated rows give repeated pieces; an empty table gives none.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))

    def cut(batches):
        encoder, end = word_encoder(vocabulary, kind), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = encoder.encode(text) + end
                for at in range(0, len(ids), 4 * longest):
                    part = ids[at : at + 4 * longest]
                    out.append((doc_id, at // (4 * longest), at // 4, len(part) // 4, zlib.crc32(part), part))
            *columns, ids = zip(*out, strict=True)
            arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.cumsum([0, *columns[3]]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                names.append("ids")
            yield pa.record_batch(arrays, names)

    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset): the rank-th piece of a length goes to the same rank's sequence.

    Pieces of one length are alike, and so are sequences with one gap; both are kept as runs of consecutive numbers. In
    descending order of length, a step matches the pieces left of a length with its successor among the gaps (the
    smallest one that holds it), each sequence taking one piece, by rank; then the gaps are updated and the next step
    follows. Where no gap is left, as many sequences as the pieces need are opened. There are at most ``capacity``
    lengths and gaps, so the work does not grow with the number of rows.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number)
    sizes: list[int] = []  # the gaps in use, ascending
    runs, opened = [], 0

    def add(gap: int, first: int, number: int) -> None:
        if gap:
            if not gaps.get(gap):
                if gap not in gaps:
                    sizes.append(gap)
                    sizes.sort()
                gaps[gap] = []
            gaps[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            gap = next((g for g in sizes if g >= length and gaps[g]), None)
            if gap is None:
                number = -(-left // (capacity // length))
                add(capacity, opened, number)
                opened += number
                continue
            first, number = gaps[gap].pop()
            taken = min(number, left)
            runs.append((length, rank, taken, first, capacity - gap))
            add(gap - length, first, taken)
            if taken < number:
                gaps[gap].append((first + taken, number - taken))
            rank, left = rank + taken, left - taken
    return runs


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best fit, longest first, gapless from offset 0.

    Pieces are range-sorted by length (then doc_id, piece, start), which gives each a rank among those of its length
    from its place in its partition and the sizes of the partitions before. The driver gets the number of pieces for
    each length (at most ``capacity`` numbers) and for each partition, steps through the classes and sends the runs
    back; every piece finds its run by its rank. A length that a third of all pieces have is spread over partitions and
    packed in the same few steps. Lengths must lie between 1 and ``capacity``. An empty table gives an empty one.
    """
    order = [F.col("length"), F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("start"), F.col("ids_crc32")]
    fields = pieces.columns

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*fields, "part_no", "row_no"]
            )
            at += n

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    # Range partitioning reads its input twice, first for the bounds: not through the tokenizer.
    ranged = materialize(pieces, "packing-pieces").repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(ranged.mapInArrow(number, f"{kinds}, part_no int, row_no long"), "packing-sorted")
    per_part = dict(numbered.groupBy("part_no").count().collect())
    per_length = dict(numbered.groupBy("length").count().collect())
    runs = best_fit_runs(per_length, capacity)

    parts = sorted(per_part)
    offsets = dict(zip(parts, np.cumsum([0, *(per_part[p] for p in parts)]).tolist(), strict=False))
    lengths = sorted(per_length)
    first_row = np.zeros(capacity + 1, np.int64)
    first_row[lengths] = np.cumsum([0, *(per_length[x] for x in lengths)])[:-1]
    #: Place of a run among all rows in sorted order, its sequence and offset.
    starts = np.array([first_row[r[0]] + r[1] for r in runs], np.int64)
    sorting = np.argsort(starts)
    starts, sequences, places = starts[sorting], np.array([r[3] for r in runs], np.int64)[sorting], np.array([r[4] for r in runs], np.int64)[sorting]

    def place(batches):
        for batch in batches:
            part, row = batch.column("part_no").to_numpy(), batch.column("row_no").to_numpy()
            index = row + np.array([offsets[p] for p in part.tolist()], np.int64)
            run = np.searchsorted(starts, index, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(fields)], pa.array(sequences[run] + index - starts[run]), pa.array(places[run])], names=[*fields, "sequence_id", "offset"]
            )

    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """A row per sequence: sequence_id, its tokens, and the documents in it. ``packed`` must have ids (``with_ids``)."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("documents"))
    )


