"""Hierarchical multi-length packing of token ids into sequences.

Each input partition is packed on its own, so nothing is shuffled. A document's ids are cut into
full windows of the longest tier; what is left is routed to the shortest tier that holds it. From
the longest tier down, a window opens with the longest waiting piece of its tier, and its gap takes
the longest pieces of shorter tiers that still fit; when none fits, the shortest waiting piece is
cut. Whenever ``PENDING`` ids wait, they are packed; what would leave a window unfilled waits on. A partition's
last, unfilled window is cut into windows of powers of two. Windows fill
step groups of equal token counts. Memory: about ``PENDING`` ids and one document, however large a partition is.

Null texts count as empty and still have the end id. Repeated rows and repeated or null doc_ids are
documents of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuo.llm import tokens
from continuo.llm.common import give_back, materialize, text_of, unbatched

TIERS = (4096, 2048, 1024, 512, 256)
STEP_WINDOWS = 16
#: Ids that wait in one task before they are packed.
PENDING = 4_000_000
#: Parts of texts that a task remembers: waiting ids share its memory with them.
PARTS = 250_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs one partition: ``add`` takes documents, ``rows`` gives the pieces of the sequences that are full.

    The last call of ``rows`` gives the rest.
    """

    def __init__(self, base: int = 0, tiers=TIERS, step_windows: int = STEP_WINDOWS):
        self.tiers = sorted(tiers, reverse=True)
        self.top = self.tiers[0]
        self.sequence, self.step, self.room, self.taken = base, base, step_windows * self.top, 0
        self.docs: dict[int, list] = {}  # those with ids waiting: doc_id, tokens, ids from the last window on, ids waiting
        self.added = self.pending = 0
        self.full: list[tuple] = []  # (doc_id, start, crc, tokens) of full windows
        self.waiting: dict[int, list[tuple[int, int]]] = {}  # by length: (document, start)
        self.lengths = 0  # bit l is set while a piece of length l waits

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.top
        for at in range(0, whole, self.top):
            self.full.append((doc_id, at, zlib.crc32(ids[at : at + self.top].astype("<u4").tobytes()), n))
        if n > whole:
            self.docs[self.added] = [doc_id, n, ids[whole:].copy(), n - whole]
            self._put(self.added, whole, n - whole)
            self.pending += n - whole
            self.added += 1

    def _put(self, k: int, start: int, length: int) -> None:
        self.waiting.setdefault(length, []).append((k, start))
        self.lengths |= 1 << length

    def _take(self, length: int) -> tuple[int, int, int]:
        k, start = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
            self.lengths &= ~(1 << length)
        return k, start, length

    def _longest(self, most: int) -> int:
        return (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1

    def _fill(self, gap: int) -> list[tuple[int, int, int]]:
        out = []
        while gap and self.lengths:
            length = self._longest(gap)
            if length > 0:
                piece = self._take(length)
            else:
                k, start, length = self._take((self.lengths & -self.lengths).bit_length() - 1)
                self._put(k, start + gap, length - gap)
                piece = (k, start, gap)
            out.append(piece)
            gap -= piece[2]
        return out

    def _sequences(self, last: bool):
        """(tier, pieces) from the longest to the shortest."""
        for waiting in self.waiting.values():
            waiting.sort(key=lambda p: (self.docs[p[0]][0] is None, self.docs[p[0]][0] or 0, p[1]), reverse=True)
        left = []
        for tier, below in zip(self.tiers, [*self.tiers[1:], 0], strict=True):
            while (length := self._longest(tier)) > below:
                first = self._take(length)
                pieces = [first, *self._fill(tier - length)]
                if sum(p[2] for p in pieces) == tier:
                    yield tier, pieces
                elif last:
                    yield from self._by_powers(pieces)
                else:
                    left += pieces
        for piece in left:
            self._put(*piece)

    @staticmethod
    def _by_powers(pieces):
        left = sum(p[2] for p in pieces)
        queue = list(reversed(pieces))
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            tier, own = size, []
            while size:
                k, start, length = queue.pop()
                if length > size:
                    queue.append((k, start + size, length - size))
                    length = size
                own.append((k, start, length))
                size -= length
            yield tier, own

    def _numbers(self, tier: int) -> tuple[int, int, int]:
        """(sequence_id, tier, step_group) of the next sequence."""
        out = self.sequence, tier, self.step + self.taken // self.room
        self.sequence, self.taken = self.sequence + 1, self.taken + tier
        return out

    def rows(self, last: bool = True):
        """(doc_id, start, length, crc, doc_tokens, sequence_id, offset, tier, step_group)."""
        self.full.sort(key=lambda f: (f[0] is None, f[0] or 0, f[1], f[2]))
        for doc_id, at, crc, n in self.full:
            sequence, tier, step = self._numbers(self.top)
            yield doc_id, at, self.top, crc, n, sequence, 0, tier, step
        self.full = []
        for tier, pieces in self._sequences(last):
            offset, (sequence, _, step) = 0, self._numbers(tier)
            for k, start, length in pieces:
                doc_id, n, ids, left = self.docs[k]
                at = start - (n - len(ids))
                yield doc_id, start, length, zlib.crc32(ids[at : at + length].astype("<u4").tobytes()), n, sequence, offset, tier, step
                offset += length
                self.docs[k][3] = left - length
                if left == length:
                    del self.docs[k]
            self.pending -= tier


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers=TIERS, step_windows: int = STEP_WINDOWS) -> DataFrame:
    """One row per piece; a sequence's pieces have offsets from 0 without gaps and fill its tier."""

    def packed(batches):
        from pyspark import TaskContext

        tokenizer, packer = tokens.load(tokenizer_path, PARTS), Packer(TaskContext.get().partitionId() << 36, tiers, step_windows)
        end = np.array([end_id], dtype=tokenizer.dtype).tobytes()
        for batch in unbatched(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                packer.add(doc_id, np.frombuffer(tokenizer.ids(text) + end, dtype=tokenizer.dtype))
                if packer.pending > PENDING:
                    yield from _batches(packer.rows(last=False))
        batch = doc_id = text = None  # what still refers to a batch holds the memory of the parts beside it
        tokenizer.forget()
        yield from _batches(packer.rows())
        del packer
        give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return materialize(texts.mapInArrow(packed, SCHEMA), "pieces")


def _batches(rows):
    """Arrow batches of bounded size."""
    import pyarrow as pa

    kinds = [c.split() for c in SCHEMA.split(", ")]
    while part := list(islice(rows, 20_000)):
        arrays = [pa.array(x, pa.int32() if kind == "int" else pa.int64()) for x, (_, kind) in zip(zip(*part, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in kinds])
