"""Language-model scores: a smoothed unigram model over words, and a causal self-attention model over subword ids with a
memory of the training texts.

1. ``_learn_counts`` reads every text once and writes its subword ids in blocks of some megabytes of text, with the
   words of each block and their training counts, dealt out by hash. A text's ids are those of the whole text, white
   space included.
2. Buckets add the counts up and answer each block with its own words' totals, so no task holds the vocabulary. Beginnings
   of texts, cut at every unit's end, are counted in the same way: what the training texts are known to go on with.
3. The attention model is trained on every window of every training document. Documents are dealt by a hash of what they
   are into shards, whose number follows their ids alone; shards descend on their own, and their parameters are averaged
   after each round, so the model doesn't depend on how the input is cut. An id's probability is that of its class, which
   the model gives beside exact counts of what follows an id, times that of the id in its class.
4. Each block's documents meet the block's totals and are scored: windows overlap, and each id is scored once. Where
   training texts begin as a text does so far, its next unit has the mean of the model's probability and of the share of
   those texts that go on with it; a training text itself isn't counted among them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Tidy, documents, drop, prepare, quoted, table, text_bytes
from .packing import _ranks

#: Bytes of text in a block, and of text for each bucket of the vocabulary.
BLOCK_TEXT, BUCKET_TEXT = 8 << 20, 24 << 20
#: Pieces of texts that are encoded at once.
PIECES = 1 << 14
#: Ids of the tokenizer with the end's (the last); classes of ids, of which the most frequent stand alone.
IDS, END = 50_257, 50_256
CLASSES, ALONE = 48, 32
#: What stands before an id: inputs of the table of what follows, of which OWN stand for one id; the model's own inputs.
FOLLOWED, OWN, INPUTS, OWN_INPUTS = 4096, 3584, 512, 384
#: Weight of the prior in the table of what follows an input.
PRIOR_WEIGHT = 4.0
#: Width of the model; ids of a window, of which CONTEXT only give context to the others. A unit of the memory is what a
#: window scores.
WIDTH, WINDOW, CONTEXT = 16, 32, 8
#: Training: ids of a shard and of a document's piece in it; rounds, of which each takes every ROUNDS-th window of a
#: shard; windows of a step, and the step size.
SHARD_IDS, PIECE_IDS = 1 << 21, 1 << 14
ROUNDS, STEP_WINDOWS, RATE = 4, 64, 0.02
PARAMETERS = {"E": (INPUTS, WIDTH), "P": (WINDOW, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "O": (WIDTH, WIDTH), "U": (WIDTH, CLASSES)}
_SIZES = [int(np.prod(s)) for s in PARAMETERS.values()]
_FIXED = 1 << 24  # parameters are added up as integers, so their mean doesn't depend on the order
_MASK = np.tri(WINDOW, dtype=np.float32)
_LOWEST = np.finfo(np.float32).min  # a bound that nothing meets: clip is faster than minimum
_PLACES = np.arange(INPUTS * WIDTH).reshape(INPUTS, WIDTH)
_ROOT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that surely begin a character other than white space; of the rest some begin both kinds.
_CUT = ~np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


ROW = "kind int, block long, bucket int, doc_id long, held boolean, total long, data binary, counts binary"
_ROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("total", pa.int64()), ("data", pa.binary()), ("counts", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _dealt_out(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets that occur, with the places of their keys."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def _learn_counts(ranks_path: str, buckets: int):
    """Kinds: 0 a document's ids, 1 words of a block and bucket with training counts, 2 training counts of all ids,
    4 beginnings of a block's texts and bucket with training counts. A word has a row's entry for each block that it is
    in, however often, so no word and no beginning grows a bucket by more than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids_seen = TaskContext.get().partitionId() << 24, np.zeros(IDS, np.int64)
        docs, size = [], 0  # of the block

        def close() -> Iterator[pa.RecordBatch]:
            doc_ids, texts = zip(*docs, strict=True)
            held = np.array(list(map(held_out, doc_ids)))
            ids, ends, pieces, numbers, owner = encoded(texts, ranks_path)
            ids_seen[:] += np.bincount(ids[np.repeat(~held, np.diff(ends, prepend=0))], minlength=IDS)
            parts = np.split(ids, ends[:-1])
            yield _rows([(0, block, None, i, bool(h), None, x.tobytes(), None) for i, h, x in zip(doc_ids, held, parts, strict=True)])
            times = np.bincount(numbers[~held[owner]], minlength=len(pieces)).astype(np.int64)  # in training texts
            words, of = _words(pieces)
            distinct = words.dictionary_encode()
            counts = np.bincount(distinct.indices.to_numpy(), times[of], len(distinct.dictionary)).astype(np.uint32)
            names = np.array(_lines(distinct.dictionary), object)
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
            rows = [(1, block, k, None, None, int(counts[at].sum()), b"\n".join(names[at]), counts[at].tobytes()) for k, at in _dealt_out(keys, buckets)]
            nodes = list(map(beginnings, parts))
            train = np.repeat(~held, list(map(len, nodes)))
            known, at = np.unique(np.concatenate(nodes), return_inverse=True)
            asked = np.bincount(at, ~train, len(known)) > 0  # by a held-out text; the count's highest bit
            times = np.bincount(at, train, len(known)).astype(np.uint32) | asked.astype(np.uint32) << np.uint32(31)
            rows += [(4, block, k, None, None, None, known[at].tobytes(), times[at].tobytes()) for k, at in _dealt_out(known, buckets)]
            yield _rows(rows)

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                docs.append((doc_id, (raw or b"").decode("utf-8", "replace")))
                size += len(raw or b"") + 1
                if size >= BLOCK_TEXT:
                    yield from close()
                    docs, size, block = [], 0, block + 1
        if docs:
            yield from close()
        if ids_seen.any():
            yield _rows([(2, block, None, None, None, None, ids_seen.tobytes(), None)])

    return run


@lru_cache(1)
def _tokens(ranks_path: str) -> pa.LargeBinaryArray:
    """The bytes of every id; the end has none."""
    encoding = _ranks(ranks_path)
    return pa.array([*map(encoding.decode_single_token_bytes, range(END)), b""], pa.large_binary())


def _parts(array: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Where a large binary or string array's values begin and end in its buffer."""
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1], array.buffers()[2]


def _strung(kind: pa.DataType, ends: np.ndarray, data) -> pa.Array:
    """An array of values that lie end to end."""
    ends = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def encoded(texts: Sequence[str], ranks_path: str) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The ids of whole texts with their ends, end to end, and where each text's end; the distinct pieces that the texts
    are cut into, the number of every piece in order, and the text that it is in.

    Texts are cut before spaces that a character other than white space follows. The tokenizer's pattern always begins a
    new match there, so a piece has the same ids wherever it stands, and each is encoded once.
    """
    encoding = _ranks(ranks_path)
    bounds, data = _parts(pa.array(texts, pa.large_string()))
    raw = np.frombuffer(data or b"", np.uint8)[: bounds[-1]]
    mark = np.append(raw == 32, False)
    mark[:-2] &= _CUT[raw[1:]]
    mark[bounds[1:] - 1] = False
    mark[bounds] = True
    starts = np.flatnonzero(mark[:-1])
    values = _strung(pa.large_string(), np.append(starts, len(raw))[1:], raw).dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds)))
    # pieces that begin as a text is cut come first; the others begin a text, and are encoded by themselves
    at, data = _parts(values.dictionary)
    raw = np.append(np.frombuffer(data or b"", np.uint8)[: at[-1]], np.zeros(2, np.uint8))
    cut = (np.diff(at) > 1) & (raw[at[:-1]] == 32) & _CUT[raw[at[:-1] + 1]]
    order, n = np.argsort(~cut, kind="stable"), int(cut.sum())
    pieces = values.dictionary.take(pa.array(order))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    numbers = place[values.indices.to_numpy()]
    want, data = _parts(pieces)
    spans = [(i, min(i + PIECES, n)) for i in range(0, n, PIECES)] + [(i, i + 1) for i in range(n, len(pieces))]
    lists = (encoding.encode_ordinary(str(data.slice(int(want[i]), int(want[j] - want[i])), "utf-8")) for i, j in spans)
    ids = np.concatenate([*(np.array(x, np.uint16) for x in lists), [END]]).astype(np.uint16)
    at = np.cumsum(np.diff(_parts(_tokens(ranks_path))[0])[ids[:-1]])
    ends = np.searchsorted(at, want[1:]) + 1
    if not np.array_equal(at[ends - 1], want[1:]):
        raise ValueError("an id spans two pieces")
    stored = _strung(pa.large_binary(), 2 * np.append(ends, len(ids)), ids)
    last = np.searchsorted(owner, np.arange(len(texts)), "right")  # a text's end is stored as a last piece
    offsets, data = _parts(stored.take(pa.array(np.insert(numbers, last, len(pieces)))))
    return np.frombuffer(data, np.uint16)[: offsets[-1] // 2], offsets[last + np.arange(1, len(texts) + 1)] // 2, pieces, numbers, owner


def _lines(words: pa.Array) -> list[bytes]:
    """Words as bytes; none has a line break."""
    none, end = (pa.scalar(x, words.type) for x in ("", "\n"))
    ends, data = _parts(pc.binary_join_element_wise(words, none, end))
    return bytes(data.slice(0, int(ends[-1]))).split(b"\n")[:-1] if len(words) else []


def _listed(joined: list[bytes]) -> pa.ListArray:
    """Lists of the words that are joined by line breaks."""
    return pc.split_pattern(pa.array(joined, pa.large_binary()), "\n")


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of texts end to end, and the text that each is in."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, owner = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), owner[some.to_numpy(zero_copy_only=False)]


def unit_ends(n: int) -> np.ndarray:
    """Where the units of a text of n ids end."""
    return np.append(np.arange(WINDOW, n, WINDOW - CONTEXT), n)


@lru_cache(1)
def _id_hashes() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, IDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers = np.empty(0, np.uint64)


def beginnings(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of a text's beginnings up to the end of each unit; that of the whole text holds its end's id."""
    global _powers
    if len(_powers) < len(ids):
        _powers = np.cumprod(np.full(2 * len(ids), _ROOT), dtype=np.uint64)
    h = np.cumsum(_id_hashes()[ids] * _powers[: len(ids)], dtype=np.uint64)[unit_ends(len(ids)) - 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket: its rows with totals instead of counts, and a row of kind 3 with the number of training words.
    Of beginnings only those are answered that two training texts have, or one and a held-out text of the block."""
    from .jaccard_join import _groups

    for rows in _groups(batches, "bucket"):
        words, begun = [r for r in rows if r["kind"] == 1], [r for r in rows if r["kind"] == 4]
        split, each = _listed([r["data"] for r in words]), [np.frombuffer(r["counts"], np.uint32) for r in words]
        known = split.flatten().dictionary_encode()
        at = known.indices.to_numpy()
        totals = np.bincount(at, np.concatenate(each), len(known.dictionary)).astype(np.int64) if words else np.empty(0, np.int64)
        ends = split.offsets.to_numpy()
        for r, first, end in zip(words, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield _rows([(1, r["block"], r["bucket"], None, None, None, r["data"], totals[at[first:end]].tobytes())])
        yield _rows([(3, None, rows[0]["bucket"], None, None, int((totals > 0).sum()), None, None)])
        nodes, counts = [np.frombuffer(r["data"], np.uint64) for r in begun], [np.frombuffer(r["counts"], np.uint32) for r in begun]
        if begun:
            known, at = np.unique(np.concatenate(nodes), return_inverse=True)
            sums = np.bincount(at, np.concatenate(counts) & np.uint32(0x7FFFFFFF), len(known)).astype(np.int64)
            for r, x, n in zip(begun, nodes, counts, strict=True):
                total = sums[np.searchsorted(known, x)]
                some = (total > 1) | (total > 0) & (n >> np.uint32(31) > 0)
                if some.any():
                    yield _rows([(4, r["block"], r["bucket"], None, None, None, x[some].tobytes(), total[some].tobytes())])


def _sums_of(kind):
    """Adds up the vectors (binary) of a column ``data``, number by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(0).to_pylist():
                v = np.frombuffer(raw, kind)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    return run


def _total(vectors: DataFrame, size: int, parts: int) -> np.ndarray:
    """The sum of vectors of whole numbers: first in each task, then in up to 64, whose few sums come to the driver."""
    once = vectors.select("data").mapInArrow(_sums_of(np.int64), "data binary")
    twice = once.repartition(max(1, min(64, parts // 16))).mapInArrow(_sums_of(np.int64), "data binary")
    out = np.zeros(size, np.int64)
    for r in twice.collect():
        out += np.frombuffer(r["data"], np.int64)
    return out


class Vocabulary:
    """Classes, inputs and in-class log probabilities (natural) of ids, from training counts of all of them."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        rest = counts[order[ALONE:]] + 0.5
        share = np.minimum((np.cumsum(rest) - rest / 2) / rest.sum() * (CLASSES - ALONE), CLASSES - ALONE - 1)
        self.classes = np.empty(IDS, np.int64)
        self.classes[order[:ALONE]] = np.arange(ALONE)
        self.classes[order[ALONE:]] = ALONE + share.astype(np.int64)
        mass = np.bincount(self.classes, counts + 0.5, CLASSES)
        self.inside = np.log((counts + 0.5) / mass[self.classes]).astype(np.float32)
        # what an id is to the next; index IDS, input 0: a text's beginning
        self.follows = np.append(OWN + np.arange(IDS) % (FOLLOWED - OWN), 0)
        self.follows[order[: OWN - 1]] = np.arange(1, OWN)
        self.inputs = np.where(np.arange(FOLLOWED) < OWN_INPUTS, np.arange(FOLLOWED), OWN_INPUTS + np.arange(FOLLOWED) % (INPUTS - OWN_INPUTS))
        self.prior = mass / mass.sum()
        self.table = np.log(np.tile(self.prior, (FOLLOWED, 1))).astype(np.float32)

    def learn(self, pairs: np.ndarray) -> None:
        """Sets the table of what follows from counts (FOLLOWED, CLASSES)."""
        pairs = pairs.reshape(FOLLOWED, CLASSES)
        self.table = np.log((pairs + PRIOR_WEIGHT * self.prior) / (pairs.sum(1, keepdims=True) + PRIOR_WEIGHT)).astype(np.float32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters as views of one vector."""
    return {k: x.reshape(s) for (k, s), x in zip(PARAMETERS.items(), np.split(flat, np.cumsum(_SIZES)[:-1]), strict=True)}


def start(seed: int = 5) -> np.ndarray:
    return (0.1 * np.random.default_rng(seed).standard_normal(sum(_SIZES))).astype(np.float32)


_ones = {n: np.ones((n, 1), np.float32) for n in (WINDOW, CLASSES)}


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ _ones[x.shape[-1]]


def _turned(x: np.ndarray) -> np.ndarray:
    """Each matrix transposed, in an order that products read fast."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _weights(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Causal attention from bounded logits, whose exponentials need no maximum, and by what its rows are to be multiplied."""
    np.clip(logits, -60, 60, out=logits)
    np.exp(logits, out=logits)
    logits *= _MASK[-logits.shape[-2] :]
    return logits, 1 / _row_sums(logits)


def gradients(p: dict, table: np.ndarray, inputs: np.ndarray, before: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the targets and gradients (one vector) of a batch of windows (n, WINDOW); causal attention with a
    residual, beside the fixed ``table`` of what follows ``before``."""
    m, scale = inputs.size, WIDTH**-0.5
    shape = (*inputs.shape, WIDTH)
    out = np.empty(sum(_SIZES), p["E"].dtype)
    g = unpack(out)
    x = np.take(p["E"], inputs, 0)
    x += p["P"]
    flat = x.reshape(m, WIDTH)
    scaled = p["Q"] * p["Q"].dtype.type(scale)
    q, k, v = (flat @ scaled).reshape(shape), (flat @ p["K"]).reshape(shape), (flat @ p["V"]).reshape(shape)
    a, r = _weights(q @ _turned(k))
    o = a @ v
    o *= r
    h = o.reshape(m, WIDTH) @ p["O"]
    h += flat
    y = h @ p["U"]
    y += np.take(table, before.ravel(), 0)
    np.clip(y, _LOWEST, 60, out=y)
    np.exp(y, out=y)
    sums = _row_sums(y)
    sums += np.float32(1e-30)
    weight = (valid.reshape(m, 1) / max(1, int(valid.sum()))).astype(y.dtype)
    at = np.arange(m) * CLASSES + targets.ravel()
    whole = y.ravel()
    picked = whole[at] / sums[:, 0]
    y *= weight / sums
    whole[at] -= weight[:, 0]
    (h.reshape(shape).transpose(0, 2, 1) @ y.reshape(*inputs.shape, CLASSES)).sum(0, out=g["U"])  # faster than one product
    dh = y @ p["U"].T
    np.matmul(o.reshape(m, WIDTH).T, dh, out=g["O"])
    do = (dh @ p["O"].T).reshape(shape)
    ds = do @ _turned(v)
    ds -= np.einsum("nij,nij->ni", do, o)[..., None]
    ds *= a
    do *= r
    dq = (ds @ k * r).reshape(m, WIDTH)
    q *= r
    dk, dv = (ds.transpose(0, 2, 1) @ q).reshape(m, WIDTH), (a.transpose(0, 2, 1) @ do).reshape(m, WIDTH)
    g["Q"][:], g["K"][:], g["V"][:] = flat.T @ dq * scale, flat.T @ dk, flat.T @ dv
    dh += dq @ scaled.T
    dh += dk @ p["K"].T
    dh += dv @ p["V"].T
    dh.reshape(shape).sum(0, out=g["P"])
    g["E"][:] = 0
    np.add.at(g["E"].ravel(), np.take(_PLACES, inputs.ravel(), 0).ravel(), dh.ravel())
    return picked, out


class Trainer:
    """Adam over batches of STEP_WINDOWS windows; ``flat`` holds all parameters."""

    def __init__(self, flat: np.ndarray, table: np.ndarray, rate: float = RATE):
        self.flat, self.table = flat.copy(), table
        self.p, self.m, self.v = unpack(self.flat), np.zeros_like(flat), np.zeros_like(flat)
        self.t, self.rate = 0, rate

    def step(self, *batch) -> np.ndarray:
        picked, g = gradients(self.p, self.table, *batch)
        self.t += 1
        rate = np.float32(self.rate / (1 + self.t / 200) ** 0.5 / (1 - 0.9**self.t))
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * g
        g *= g
        self.v *= np.float32(0.99)
        self.v += np.float32(0.01) * g
        root = np.sqrt(self.v * np.float32(1 / (1 - 0.99**self.t)))
        root += np.float32(1e-6)
        self.flat -= rate * self.m / root
        return picked


class Windows:
    """All windows of a shard: its pieces end to end (``sizes``), and the id before each (IDS: none)."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, before: np.ndarray, vocabulary: Vocabulary):
        self.ids, self.vocabulary = ids, vocabulary
        first, counts = np.cumsum(sizes) - sizes, -(-sizes // WINDOW)
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        self.starts, self.ends = np.repeat(first, counts) + inside * WINDOW, np.repeat(first + sizes, counts)
        self.before = np.where(inside > 0, ids[np.maximum(self.starts - 1, 0)], np.repeat(before, counts))

    def batches(self, turn: int) -> Iterator[tuple]:
        """Every ROUNDS-th window from the ``turn``-th on; the rounds together take every window once."""
        starts, ends, before = (x[turn::ROUNDS] for x in (self.starts, self.ends, self.before))
        v = self.vocabulary
        for i in range(0, len(starts), STEP_WINDOWS):
            at = starts[i : i + STEP_WINDOWS, None] + np.arange(WINDOW)
            valid = at < ends[i : i + STEP_WINDOWS, None]
            ids = self.ids[np.minimum(at, len(self.ids) - 1)]
            follows = v.follows[np.hstack([before[i : i + STEP_WINDOWS, None], ids[:, :-1]])]
            yield v.inputs[follows], follows, v.classes[ids], valid


PIECE = "shard long, place long, before int, data binary"
_PIECE_ROW = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("before", pa.int32()), ("data", pa.binary())])


def _deal(state, shards: int):
    """Pieces of training documents with their shard and their place in it, both from a hash of what the piece is; and
    a last row without a shard that counts what follows what."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = state.value
        pairs = np.zeros(FOLLOWED * CLASSES, np.int64)
        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, np.uint16)
                before = vocabulary.follows[np.concatenate(([IDS], ids[:-1]))]
                np.add.at(pairs, before * CLASSES + vocabulary.classes[ids], 1)
                for i, at in enumerate(range(0, len(ids), PIECE_IDS)):
                    part = ids[at : at + PIECE_IDS].tobytes()
                    place = xxhash.xxh3_64_intdigest(part, seed=xxhash.xxh32_intdigest(f"{doc_id}:{i}".encode())) >> 1
                    rows.append((place % shards, place, int(ids[at - 1]) if at else IDS, part))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECE_ROW, strict=True)], schema=_PIECE_ROW)
        if pairs.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((None, None, None, pairs.tobytes()), _PIECE_ROW, strict=True)], schema=_PIECE_ROW)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (sizes, before, data) for each shard."""
    from .jaccard_join import _groups

    for rows in _groups(batches, "shard"):
        sizes = np.array([len(r["data"]) // 2 for r in rows], np.int64)
        columns = [sizes.tobytes(), np.array([r["before"] for r in rows], np.int64).tobytes(), b"".join(r["data"] for r in rows)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], ["sizes", "before", "data"])


def _train(state, turn: int):
    """One row of a task: the parameters of its shards' trainers, weighted by steps, and the number of steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, vocabulary = state.value
        total = None
        for b in batches:
            for sizes, before, data in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                windows = Windows(np.frombuffer(data, np.uint16), np.frombuffer(sizes, np.int64), np.frombuffer(before, np.int64), vocabulary)
                trainer = Trainer(flat, vocabulary.table)
                for batch in windows.batches(turn):
                    trainer.step(*batch)
                if trainer.t:
                    values = np.append(np.round(np.clip(trainer.flat, -50, 50).astype(np.float64) * _FIXED).astype(np.int64), 1) * trainer.t
                    total = values if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    return run


class Scorer:
    """Natural log probabilities of all ids of a text, each scored once, from tables made of the parameters."""

    CHUNK = 64  # windows of one batch, whose arrays stay in a core's cache; the last is filled up, so all are alike

    def __init__(self, flat: np.ndarray, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        p = unpack(flat)
        qkv = np.hstack([p["Q"] * np.float32(WIDTH**-0.5), p["K"], p["V"]])
        e = p["E"][vocabulary.inputs]
        self.by_input, self.by_place = e @ qkv, p["P"] @ qkv
        self.out = p["O"] @ p["U"]
        self.direct, self.placed = e @ p["U"] + vocabulary.table, p["P"] @ p["U"]

    def classes(self, before: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Of windows (n, WINDOW) the log probabilities of ``targets``, which are the classes of their last places."""
        first = WINDOW - targets.shape[1]
        x = np.take(self.by_input, before, 0)
        x += self.by_place
        q, k, v = x[:, first:, :WIDTH], x[..., WIDTH : 2 * WIDTH], x[..., 2 * WIDTH :]
        a, r = _weights(q @ _turned(k))
        o = a @ v
        o *= r
        logits = o.reshape(-1, WIDTH) @ self.out
        logits += np.take(self.direct, before[:, first:].ravel(), 0)
        logits = logits.reshape(*targets.shape, CLASSES)
        logits += self.placed[first:]
        np.clip(logits, _LOWEST, 60, out=logits)
        flat = logits.reshape(-1, CLASSES)
        picked = np.take(flat.ravel(), np.arange(0, flat.size, CLASSES) + targets.ravel())
        np.exp(flat, out=flat)
        return (picked - np.log(_row_sums(flat)[:, 0] + np.float32(1e-30))).reshape(targets.shape)

    def units(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of every unit of the texts, end to end, and how many units each text has."""
        sizes = np.array([len(t) for t in texts])
        ids = np.concatenate(texts)
        base = np.cumsum(sizes) - sizes
        step = WINDOW - CONTEXT
        counts = 1 + np.maximum(0, -(-(sizes - WINDOW) // step))
        owner = np.repeat(np.arange(len(texts)), counts)
        begin = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
        previous = np.empty(len(ids), np.int64)
        previous[1:] = ids[:-1]
        previous[base] = IDS
        # a window may run on into what follows its text, which nothing before looks at
        before = np.append(self.vocabulary.follows[previous], np.zeros(WINDOW, np.int64))
        target = np.append(self.vocabulary.classes[ids], np.zeros(WINDOW, np.int64))
        out = np.empty(len(owner))
        for which, context in ((begin == 0, 0), (begin > 0, CONTEXT)):
            which, place = np.flatnonzero(which), np.arange(context, WINDOW)
            for i in range(0, len(which), self.CHUNK):
                own = which[i : i + self.CHUNK]
                filled = np.append(own, np.repeat(own[:1], self.CHUNK - len(own)))
                at = (base[owner[filled]] + begin[filled])[:, None]
                got = self.classes(before[at + np.arange(WINDOW)], target[at + place])[: len(own)]
                got[begin[own][:, None] + place >= sizes[owner[own]][:, None]] = 0
                out[own] = got.sum(1, dtype=np.float64)
        inside = np.concatenate(([0.0], np.cumsum(self.vocabulary.inside[ids], dtype=np.float64)))
        ends = base[owner] + np.minimum(sizes[owner], begin + WINDOW)
        starts = base[owner] + np.where(begin > 0, begin + CONTEXT, 0)
        return out + inside[ends] - inside[starts], counts

    def score(self, texts: list[np.ndarray], remembered=None) -> np.ndarray:
        """log10 probability of each text. ``remembered``: for every unit in how many (other) training texts the text's
        beginning up to the unit's end occurs, and how many share what is before the unit."""
        log, counts = self.units(texts)
        if remembered is not None:
            seen, of = remembered
            with np.errstate(divide="ignore", invalid="ignore"):
                log = np.where(of > 0, np.logaddexp(np.log(seen / of), log) - np.log(2), log)
        return np.add.reduceat(log, np.cumsum(counts) - counts) / np.log(10)


def remembered(texts: list[np.ndarray], held: list[bool], nodes: np.ndarray, totals: np.ndarray, docs_train: int) -> tuple[np.ndarray, np.ndarray]:
    """For every unit of the texts: the training texts, but for the text itself, that have its beginning up to the unit's
    end, and up to its start. ``nodes`` (ascending) with ``totals`` are the beginnings that are known."""
    each = list(map(beginnings, texts))
    sizes, own, out = np.array(list(map(len, each))), np.concatenate(each), np.array(held, bool)
    seen = np.zeros(len(own), np.int64)
    if len(nodes):
        at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
        seen = np.where(nodes[at] == own, totals[at] - np.repeat(~out, sizes), 0)
    of = np.append(0, seen[:-1])
    of[np.cumsum(sizes) - sizes] = docs_train - ~out
    return seen.astype(np.float64), of.astype(np.float64)


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(state, ranks_path: str, n_train: int, n_distinct: int):
    names = [x.split()[0] for x in SCORE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, block, rows = Scorer(*state.value[:2]), None, {1: [], 4: [], 0: []}
        for b in batches:
            for kind, at, *row in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                if at != block and rows[0]:
                    yield emit(scorer, rows)
                    rows = {1: [], 4: [], 0: []}
                block = at
                rows[kind].append(row)
        if rows[0]:
            yield emit(scorer, rows)

    def emit(scorer, rows) -> pa.RecordBatch:
        """The rows of a block."""
        docs_train = state.value[2]
        nodes, totals = (np.concatenate([np.frombuffer(r[i], t) for r in rows[4]] or [np.empty(0, t)]) for i, t in ((2, np.uint64), (3, np.int64)))
        order = np.argsort(nodes)
        memory = nodes[order], totals[order]
        lowest = np.log10(n_train + 0.5 * (n_distinct + 1))
        counts = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows[1]] or [np.empty(0, np.int64)])
        own = _listed([r[2] for r in rows[1]]).flatten()
        doc_ids, held, data = (list(x) for x in list(zip(*rows[0], strict=True))[:3])
        texts = [np.frombuffer(x, np.uint16) for x in data]
        offsets, raw = _parts(_tokens(ranks_path).take(pa.array(np.concatenate(texts))))
        words, owner = _words(_strung(pa.large_string(), offsets[np.cumsum(list(map(len, texts)))], raw or b""))
        count = counts[pc.index_in(words.cast(pa.large_binary()), value_set=own).to_numpy()]
        sums = lambda x: np.bincount(owner, x, len(texts))
        n_words, known = sums(None) + 1, sums(count > 0).astype(np.int64) + (docs_train > 0)
        base = sums(np.log10(count + 0.5) - lowest) + np.log10(docs_train + 0.5) - lowest
        some = [slice(i, i + BATCH_ROWS) for i in range(0, len(texts), BATCH_ROWS)]
        scores = np.round(np.concatenate([scorer.score(texts[x], remembered(texts[x], held[x], *memory, docs_train)) for x in some]), 4)
        columns = [doc_ids, held, n_words, known, np.full(len(texts), n_train), base, scores]
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, over its whole text.

    Training rows are those whose crc32(doc_id as text) mod 5 is not 1. The score of a training row is the model's
    without what the memory has of that row itself. Rows don't depend on how the input is cut into partitions.

    Null texts count as empty (one end token); null ids are training rows; repeated rows count and are scored each; with
    no training row all counts are zero; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    size = text_bytes(docs, text)
    buckets, blocks = max(8, -(-size // BUCKET_TEXT)), max(8, -(-size // BLOCK_TEXT))
    read = docs.select(quoted(doc_id)[0].cast("long").alias("doc_id"), *quoted(text)).mapInArrow(Tidy(_learn_counts(ranks_path, buckets)), ROW)
    read = table(read, "lm", "kind")
    texts = read.where("kind = 0")
    totals = table(read.where("kind IN (1, 4)").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(Tidy(_add_up), ROW), "totals", "kind")
    train_docs = texts.where("NOT held").count()
    n_words = read.where("kind = 1").agg(F.sum("total")).first()[0] or 0
    n_distinct = totals.where("kind = 3").agg(F.sum("total")).first()[0] or 0
    counts = _total(read.where("kind = 2"), IDS, blocks)
    vocabulary = Vocabulary(counts)
    shards = max(1, -(-int(counts.sum()) // SHARD_IDS))
    state = spark.sparkContext.broadcast(vocabulary)
    dealt = table(texts.where("NOT held").select("doc_id", "data").mapInArrow(_deal(state, shards), PIECE), "pieces")
    vocabulary.learn(_total(dealt.where("shard IS NULL"), FOLLOWED * CLASSES, blocks))
    pieces = dealt.where("shard IS NOT NULL").repartition(shards, "shard").sortWithinPartitions("shard", "place")
    packed = table(pieces.mapInArrow(_pack, "sizes binary, before binary, data binary"), "shards")
    drop(dealt)
    flat = start()
    for turn in range(ROUNDS):
        state = spark.sparkContext.broadcast((flat, vocabulary))
        total = _total(packed.mapInArrow(_train(state, turn), "data binary"), len(flat) + 1, shards)
        if total[-1]:
            flat = (total[:-1] / (total[-1] * _FIXED)).astype(np.float32)
    drop(packed)
    state = spark.sparkContext.broadcast((flat, vocabulary, train_docs))
    columns = ["kind", "block", "doc_id", "held", "data", "counts"]
    both = texts.select(*columns).unionByName(totals.where("kind IN (1, 4)").select(*columns))
    both = both.repartition(blocks, "block").sortWithinPartitions("block", F.desc("kind"))
    return both.mapInArrow(Tidy(_score(state, ranks_path, n_words + train_docs, n_distinct + (train_docs > 0))), SCORE)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
