"""Packing whole documents into as few sequences as possible, by minimum bin slack.

A document longer than a sequence is cut into full pieces, the first one shorter; every other document stays whole.
Only lengths decide how pieces combine, and there are no more of them than ids in a sequence. So the plan is made from
the histogram of all lengths, whose size no input changes: per sequence, a bitset of the sums that the available
lengths reach beside the longest one gives the fullest feasible combination, which is then removed, as often as the
lengths last. Pieces are numbered within their length (by task, then by a running number), and the plan says which
numbers go where. Nothing is shuffled but counts.

Null texts are empty and still have the end id. Every row is a document of its own, repeated rows and null doc_ids
too. Very long texts give many pieces. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from continuo.llm import byte_tokens
from continuo.llm.common import checked_broadcast, materialize, text_of, unbatched

SIZE = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: A length and a piece's number within it, as one integer for the search in the plan.
_NUMBER_BITS = 44
_BATCH_ROWS = 20_000


def fullest(available: dict[int, int], room: int) -> list[int]:
    """The lengths, each at most as often as available, with the greatest sum that ``room`` holds.

    Bit s of ``reach`` is set while a combination of sum s exists. Longer lengths go first, so where sums are equal
    short ones, which fit later gaps better, stay.
    """
    mask, reach, before = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        for _ in range(min(available[length], room // length)):
            more = reach | (reach << length) & mask
            if more == reach:
                break
            before.append((length, reach))
            reach = more
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, []
    for length, then in reversed(before):
        if not then >> total & 1:
            taken.append(length)
            total -= length
    return taken


def plan(counts: dict[int, int], size: int = SIZE):
    """(length, first number, first sequence, pieces a sequence, offset of the first) of all pieces.

    Each step takes the longest length that is left and fills the rest of its sequence; equal sequences are one step,
    so there are at most as many steps as lengths can run short: a few thousand, whatever the counts.
    """
    left, taken, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        rest = {x: n - (x == longest) for x, n in left.items()}
        combination = [longest, *fullest({x: n for x, n in rest.items() if n}, size - longest)]
        each: dict[int, int] = {}
        for length in combination:
            each[length] = each.get(length, 0) + 1
        times, offset = min(left[x] // k for x, k in each.items()), 0
        for length, k in each.items():
            rows.append((length, taken[length], sequence, k, offset))
            offset += k * length
            taken[length] += times * k
            left[length] -= times * k
            if not left[length]:
                del left[length]
        sequence += times
    rows.sort()
    return rows


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = SIZE) -> DataFrame:
    """All pieces, numbered from 0 within their task and length."""

    def pieces(batches):
        from pyspark import TaskContext

        tokenizer, task, next_number = byte_tokens.load(tokenizer_path), TaskContext.get().partitionId(), {}
        end, rows = np.array([end_id], dtype=tokenizer.dtype).tobytes(), []
        for batch in unbatched(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.frombuffer(tokenizer.ids(text) + end, dtype=tokenizer.dtype).astype("<u4").tobytes()
                n = len(ids) // 4
                start, length = 0, (n - 1) % size + 1
                for piece in range(-(-n // size)):
                    number = next_number.get(length, 0)
                    next_number[length] = number + 1
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((doc_id, piece, start, length, crc, task, number))
                    start, length = start + length, size
                    if len(rows) >= _BATCH_ROWS:
                        yield _batch(rows, PIECES)
                        rows = []
        tokenizer.forget()
        yield _batch(rows, PIECES)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return materialize(texts.mapInArrow(pieces, PIECES), "slack-pieces")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = cut(docs, tokenizer_path, end_id, size)
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "slack-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # ``size`` rows at most
    planned = plan({r["length"]: r["n"] for r in histogram}, size)
    steps = docs.sparkSession.sparkContext.broadcast(np.array(planned, dtype=np.int64).reshape(-1, 5).T.copy())
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(checked_broadcast(base, counts.count()), ["task", "length"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("number"))

    def placed(batches):
        import pyarrow as pa

        lengths, first, sequence, each, offset = steps.value
        keys = (lengths << _NUMBER_BITS) + first
        for batch in batches:
            length, number = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.searchsorted(keys, (length << _NUMBER_BITS) + number, "right") - 1
            sequence_of, place = np.divmod(number - first[at], each[at])
            kept = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns = [*kept, pa.array(sequence[at] + sequence_of), pa.array(offset[at] + place * length)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PLACED.split(", ")])

    return numbered.mapInArrow(placed, PLACED)


def _batch(rows: list[tuple], schema: str):
    """One Arrow batch of rows."""
    import pyarrow as pa

    kinds = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    arrays = [pa.array(x, pa.int32() if kind == "int" else pa.int64()) for x, (_, kind) in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in kinds])
