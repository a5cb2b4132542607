"""Hierarchical packing of token ids into windows of several context sizes."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Tidy, documents, prepare

#: Context sizes, shortest first, and the id that ends a document.
TIERS, END_ID = (256, 512, 1024, 2048), 1
#: Tokens that one pass of the packer takes; the rest of each pass goes on into the next.
CHUNK = 1 << 21
#: Windows' worth of tokens (of the longest tier) in a training step.
STEP_WINDOWS = 16
_SPECIAL = "<|endoftext|>"


@lru_cache(1)
def _ranks(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _full(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(text: str, json_path: str, ranks_path: str) -> np.ndarray:
    """Ids of a text by the tokenizer of ``json_path`` without added tokens.

    The rank file holds the same vocabulary and gives the same ids several times faster; only texts with the special
    token's own string, which the tokenizer reads as that token, take the slow way.
    """
    if _SPECIAL in text:
        return np.array(_full(json_path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(_ranks(ranks_path).encode_ordinary(text), np.uint32)


class Packer:
    """Pieces are (document, start, length). Windows come out as (tier, [pieces]); every one but the last few is full."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.queues = tiers, [[] for _ in tiers]  # each queue is sorted by length

    def route(self, doc: int, start: int, length: int) -> None:
        """To the shortest tier that holds the piece."""
        t = next(i for i, size in enumerate(self.tiers) if length <= size)
        q = self.queues[t]
        q.insert(bisect_right(q, length, key=lambda x: x[2]), (doc, start, length))

    def _fill(self, gap: int, below: int) -> tuple | None:
        """The longest piece under tier ``below`` that fits the gap, or else one cut to fit it."""
        for t in range(below, -1, -1):
            q = self.queues[t]
            if k := bisect_right(q, gap, key=lambda x: x[2]):
                return q.pop(k - 1)
        for t in range(below + 1):
            if self.queues[t]:
                doc, start, length = self.queues[t].pop()
                self.route(doc, start + gap, length - gap)
                return doc, start, gap
        return None

    def windows(self, flush: bool) -> Iterator[tuple[int, list[tuple]]]:
        """Packs each tier from the longest: its own pieces first, gaps from shorter tiers. Without ``flush`` a window
        that can't be filled goes back to the queues for the next pass."""
        for t in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[t]
            while self.queues[t]:
                window, gap = [], size
                while gap and (piece := self._fill(gap, t)):
                    window.append(piece)
                    gap -= piece[2]
                if not gap:
                    yield size, window
                elif t or not flush:
                    if t == 0 or sum(p[2] for p in window) <= self.tiers[t - 1] or not flush:
                        for p in window:
                            self.route(*p)
                        break
                    # cut what there is to a full window of the next shorter tier; the rest is routed again
                    left = self.tiers[t - 1]
                    short = []
                    for doc, start, length in window:
                        n = min(length, left)
                        if n:
                            short.append((doc, start, n))
                        if length > n:
                            self.route(doc, start + n, length - n)
                        left -= n
                    yield self.tiers[t - 1], short
                else:
                    yield size, window


def _pack(json_path: str, ranks_path: str, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, held, longest = Packer(tiers), {}, tiers[-1]
        sequence = step = 0

        def emit(flush: bool) -> pa.RecordBatch:
            nonlocal sequence, step, full
            windows = full + list(packer.windows(flush))
            full = []
            steps = max(1, round(sum(size for size, _ in windows) / (STEP_WINDOWS * longest)))
            rows = []
            for k, (tier, pieces) in enumerate(sorted(windows, key=lambda w: -w[0])):
                turn = k % (2 * steps)  # there and back, so that steps get as many windows of each tier
                group, offset = (part << 32) + step + min(turn, 2 * steps - 1 - turn), 0
                for doc, start, length in pieces:
                    doc_id, ids = held[doc]
                    rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), (part << 32) + sequence, offset, tier, group))
                    offset += length
                sequence += 1
            step += steps
            waiting = {p[0] for q in packer.queues for p in q}
            for doc in [d for d in held if d not in waiting]:
                del held[doc]
            columns = zip(*rows, strict=True) if rows else [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], OUT)

        tokens = number = 0
        full: list = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(token_ids(text or "", json_path, ranks_path), np.uint32(END_ID)).astype("<u4")
                held[number] = doc_id, ids
                cut = len(ids) - len(ids) % longest
                full += [(longest, [(number, at, longest)]) for at in range(0, cut, longest)]
                if cut < len(ids):
                    packer.route(number, cut, len(ids) - cut)
                number += 1
                tokens += len(ids)
                if tokens >= CHUNK:
                    tokens = 0
                    yield emit(False)
        yield emit(True)

    return run


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """A row for each piece: where its document's ids lie in which sequence (see OUT), with tier and step group.

    Whole windows of the longest tier are cut off first; what remains of a document goes to the shortest tier that
    holds it. Tiers are packed from the longest: gaps take the longest piece of a shorter tier that fits, or a piece
    cut to fit, so windows are full, and only the last window of an input partition is padded. Every partition packs
    for itself as it streams: no shuffle, memory bounded by CHUNK tokens and the longest document. Step groups deal
    out windows of each tier in turn and back.

    A null text is empty (its end id alone); null ids, ties and repeated rows are documents of their own; an empty
    table gives an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    files = json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(Tidy(_pack(*files, tiers)), ", ".join(f"{c} long" for c in OUT))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
