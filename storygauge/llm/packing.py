"""Hierarchical multi-length packing of documents into training sequences.

A document's ids and one end id are cut into pieces. Full pieces of the longest tier are sequences of their own; the rest
of a document goes to the shortest tier that holds it. Tiers are packed from the longest to the shortest: a sequence
starts with a piece of its tier, and its gap is filled with the longest pieces of shorter tiers that fit, the last one cut
to fit exactly. What is left at the end of a task is cut into powers of two, so no sequence needs padding. Sequences of
one length make up step groups of equal token counts; the last groups of a task mix lengths.

Every task packs the documents it reads: nothing is shuffled, a task holds one buffer of about ``BUFFER`` ids, and a task
that is run again gives the same pieces. A null text is empty and has the end id only. Repeated rows and null ids are
packed like any others, an empty table gives no piece, and other columns are not read.

Ids are those of the byte-level BPE vocabulary in ``byte_bpe_50k``, made from its rank file and the one token that the JSON file
adds to it, so that a text which holds that token's string gets its id, as from the JSON file (tested).
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from storygauge.llm.common import per_process, small_batches, texts

END, LONGEST, TIERS = 1, 2048, (2048, 1024, 512, 256)
STEP_TOKENS = 16 * LONGEST
BUFFER = 1 << 20
ADDED_TOKENS = {"<|endoftext|>": 50256}  # fixed value: what the vocabulary adds to its ranks
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, step_group long"
)


def encoder(path: str | None = None):
    """The encoder of a rank file, by default the public 50k byte-level vocabulary; one a worker process."""
    def make():
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED_TOKENS)

    return per_process(f"encoder {path}", make)


class Packer:
    """Packs one task's documents. Pieces are (length, document, start, ids, tokens of the document)."""

    def __init__(self, part: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = sorted(tiers, reverse=True), step_tokens
        self.base, self.sequences, self.groups = part << 32, 0, 0
        self.pool: list[tuple] = []  # pieces in waiting, by length
        self.held = 0
        self.open: dict[int, list[list[tuple]]] = {}  # by length, the sequences of a step group that is not full
        self.out: list[tuple] = []
        self.serial = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        longest, total = self.tiers[0], len(ids)
        whole = total - total % longest
        for start in range(0, whole, longest):
            self.close([self.piece(doc_id, start, ids[start:start + longest], total)])
        if whole < total:
            self.wait(self.piece(doc_id, whole, ids[whole:], total))
        if self.held >= BUFFER:
            self.pack(last=False)

    def piece(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> tuple:
        self.serial += 1
        return (len(ids), self.serial, doc_id, start, ids, total)

    def wait(self, piece: tuple) -> None:
        bisect.insort(self.pool, piece, key=lambda p: p[:2])
        self.held += piece[0]

    def take(self, place: int) -> tuple:
        piece = self.pool.pop(place)
        self.held -= piece[0]
        return piece

    def fill(self, sequence: list[tuple], gap: int) -> None:
        """Fills a gap with the longest pieces that fit, then with a part of the shortest that does not."""
        while gap:
            place = bisect.bisect_right(self.pool, gap, key=lambda p: p[0])
            piece = self.take(place - 1 if place else 0)
            if piece[0] > gap:
                size, _, doc_id, start, ids, total = piece
                self.wait(self.piece(doc_id, start + gap, ids[gap:], total))
                piece = self.piece(doc_id, start, ids[:gap], total)
            sequence.append(piece)
            gap -= piece[0]

    def pack(self, last: bool) -> None:
        """Packs what waits, tier by tier; until the last call enough is left in waiting to fill later gaps."""
        keep = 0 if last else BUFFER // 8
        for tier, shorter in zip(self.tiers, [*self.tiers[1:], 0]):
            while self.pool and self.pool[-1][0] > shorter and self.held >= max(tier, keep):
                sequence: list[tuple] = []
                self.fill(sequence, tier)
                self.close(sequence)
        while last and self.held:
            size = 1 << min(self.held.bit_length() - 1, self.tiers[0].bit_length() - 1)
            sequence = []
            self.fill(sequence, size)
            self.close(sequence)

    def close(self, sequence: list[tuple]) -> None:
        length = sum(p[0] for p in sequence)
        waiting = self.open.setdefault(length, [])
        waiting.append(sequence)
        if len(waiting) * length >= self.step_tokens:
            self.emit(self.open.pop(length))

    def emit(self, sequences: list[list[tuple]]) -> None:
        for sequence in sequences:
            offset, length = 0, sum(p[0] for p in sequence)
            for size, _, doc_id, start, ids, total in sequence:
                self.out.append((doc_id, start, size, ids, total, self.base + self.sequences, offset, length, self.base + self.groups))
                offset += size
            self.sequences += 1
        self.groups += 1

    def finish(self) -> None:
        self.pack(last=True)
        rest = [s for length in sorted(self.open, reverse=True) for s in self.open[length]]
        self.open, group, tokens = {}, [], 0
        for sequence in rest:
            size = sum(p[0] for p in sequence)
            if group and tokens + size > self.step_tokens:
                self.emit(group)
                group, tokens = [], 0
            group.append(sequence)
            tokens += size
        if group:
            self.emit(group)

    def drained(self, with_ids: bool) -> pa.RecordBatch:
        doc_id, start, size, ids, total, sequence, offset, length, group = zip(*self.out)
        self.out = []
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        columns = [doc_id, start, size, crc, total, sequence, offset, length, group]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place and checksum, its sequence and offset there, and the step group.

    ``path`` names a rank file every executor can read; ``with_ids`` adds the ids themselves. Tiers are powers of two.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode.encode_to_numpy(text.as_py(), allowed_special="all")
                packer.add(doc_id, np.append(ids.astype(np.uint32), np.uint32(END)))
                if len(packer.out) >= 4096:
                    yield packer.drained(with_ids)
        packer.finish()
        if packer.out:
            yield packer.drained(with_ids)

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
