"""Language-model scores: gradients, learning, windows, the memory, and independence of partitions."""

import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tessera.llm import lm_scoring, packing
from tests.llm.test_llm import files, none, odd  # noqa: F401


def vocabulary(rng):
    v = lm_scoring.Vocabulary(rng.integers(0, 50, lm_scoring.IDS))
    v.learn(rng.integers(0, 9, lm_scoring.FOLLOWED * lm_scoring.CLASSES))
    return v


def shard(texts, v):
    ids = [np.asarray(t, np.uint16) for t in texts]
    return lm_scoring.Windows(np.concatenate(ids), np.array(list(map(len, ids))), np.full(len(ids), lm_scoring.IDS), v)


def test_gradients():
    rng = np.random.default_rng(0)
    v = vocabulary(rng)
    flat = lm_scoring.start().astype(np.float64) + 0.1 * rng.standard_normal(sum(lm_scoring._SIZES))
    batch = next(shard([rng.integers(0, lm_scoring.IDS, 650)], v).batches(0))
    assert batch[0].shape == (6, lm_scoring.WINDOW) and not batch[3].all()
    loss = lambda f: -(np.log(lm_scoring.gradients(lm_scoring.unpack(f), v.table, *batch)[0]) * batch[3].ravel()).sum() / batch[3].sum()
    _, g = lm_scoring.gradients(lm_scoring.unpack(flat), v.table, *batch)
    first = 0
    for size in lm_scoring._SIZES:
        used = first + np.flatnonzero(np.abs(g[first : first + size]) > 1e-5)
        for at in rng.choice(used, 4):
            up, down = flat.copy(), flat.copy()
            up[at] += 1e-4
            down[at] -= 1e-4
            slope = (loss(up) - loss(down)) / 2e-4
            assert abs(slope - g[at]) < 1e-5 + 0.02 * abs(slope)
        first += size


def test_attention_learns_what_the_table_cannot():
    """Texts whose period is longer than a pair: the trained model beats itself with the attention's output at 0."""
    rng = np.random.default_rng(1)
    v = lm_scoring.Vocabulary(np.where(np.arange(lm_scoring.IDS) < 40, 100, 0))
    text = lambda: np.tile(rng.permutation(20), 20)[:300].astype(np.uint16)
    train = [text() for _ in range(400)]
    pairs = np.zeros((lm_scoring.FOLLOWED, lm_scoring.CLASSES), np.int64)
    for t in train:
        np.add.at(pairs, (v.follows[np.concatenate(([lm_scoring.IDS], t[:-1]))], v.classes[t]), 1)
    v.learn(pairs)
    t = lm_scoring.Trainer(lm_scoring.start(), v.table)
    for turn in range(lm_scoring.ROUNDS):
        for batch in shard(train, v).batches(turn):
            t.step(*batch)
    held = [text() for _ in range(5)]
    none_ = t.flat.copy()
    lm_scoring.unpack(none_)["O"][:] = 0
    ids = sum(map(len, held))
    of = lambda f: lm_scoring.Scorer(f, v).score(held).sum() / ids
    assert of(t.flat) > max(of(none_), of(0 * t.flat)) + 0.02


def test_attention_helps_on_held_out_documents(spark):
    """On the documents of sf0.01, against the table of pairs alone and against the attention's output at 0."""
    encoding = packing._ranks(files()[1])
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(3000).collect()
    ids = {r.doc_id: np.array([*encoding.encode_ordinary(r.text or ""), lm_scoring.END], np.uint16) for r in rows}
    train, held = ([x for i, x in ids.items() if lm_scoring.held_out(i) is h] for h in (False, True))
    v = lm_scoring.Vocabulary(np.bincount(np.concatenate(train), minlength=lm_scoring.IDS))
    pairs = np.zeros((lm_scoring.FOLLOWED, lm_scoring.CLASSES), np.int64)
    for t in train:
        np.add.at(pairs, (v.follows[np.concatenate(([lm_scoring.IDS], t[:-1]))], v.classes[t]), 1)
    v.learn(pairs)
    trainer = lm_scoring.Trainer(lm_scoring.start(), v.table)
    for turn in range(lm_scoring.ROUNDS):
        for batch in shard(train, v).batches(turn):
            trainer.step(*batch)
    n = sum(map(len, held))
    without = trainer.flat.copy()
    lm_scoring.unpack(without)["O"][:] = 0
    of = lambda f: lm_scoring.Scorer(f, v).score(held).sum() / n
    assert of(trainer.flat) > of(without) + 0.06 and of(trainer.flat) > of(0 * trainer.flat) + 0.03


def test_scores_each_id_once():
    rng = np.random.default_rng(2)
    v = vocabulary(rng)
    flat = 3 * lm_scoring.start()
    p, s = lm_scoring.unpack(flat), lm_scoring.Scorer(flat, v)
    for n in (1, 31, 32, 33, 56, 57, 200):
        ids = rng.integers(0, lm_scoring.IDS, n).astype(np.uint16)
        previous = v.follows[np.concatenate(([lm_scoring.IDS], ids[:-1]))]
        step, total, at, units = lm_scoring.WINDOW - lm_scoring.CONTEXT, 0.0, 0, []
        while True:  # one window after the other, without tables
            span = np.arange(at, min(at + lm_scoring.WINDOW, n))
            x = p["E"][v.inputs[previous[span]]] + p["P"][: len(span)]
            a = x @ p["Q"] @ (x @ p["K"]).T * lm_scoring.WIDTH**-0.5
            a = np.where(np.tri(len(span), dtype=bool), np.exp(a), 0)
            h = x + a / a.sum(1, keepdims=True) @ (x @ p["V"]) @ p["O"]
            y = h @ p["U"] + v.table[previous[span]]
            got = y[np.arange(len(span)), v.classes[ids[span]]] - np.log(np.exp(y).sum(1)) + v.inside[ids[span]]
            units.append(got[lm_scoring.CONTEXT if at else 0 :].sum())
            if at + lm_scoring.WINDOW >= n:
                break
            at += step
        logs, counts = s.units([ids, ids])
        assert counts.tolist() == [len(units)] * 2 == [len(lm_scoring.unit_ends(n))] * 2 and np.allclose(logs, units * 2, rtol=1e-4)
        assert math.isclose(sum(units) / math.log(10), s.score([ids])[0], rel_tol=1e-4)


def test_rounds_take_every_window_once():
    v = vocabulary(np.random.default_rng(3))
    sizes = [1, 31, 64, 256, 700, 9000, 40]
    w = shard([np.full(n, 7) for n in sizes], v)
    assert sum(int(b[3].sum()) for turn in range(lm_scoring.ROUNDS) for b in w.batches(turn)) == sum(sizes)
    assert len(w.starts) == sum(-(-n // lm_scoring.WINDOW) for n in sizes)


def test_memory_against_brute_force():
    """Shares of the other training texts that begin alike, over texts that repeat and part."""
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 200, 300).astype(np.uint16) for _ in range(3)]
    texts = [np.concatenate((base[i % 3][: int(rng.integers(1, 300))], rng.integers(0, 9, int(rng.integers(0, 40))).astype(np.uint16), [lm_scoring.END])).astype(np.uint16) for i in range(40)] + [base[0]] * 3
    held = [i % 4 == 1 for i in range(len(texts))]
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    nodes, n = np.unique(np.concatenate([lm_scoring.beginnings(t) for t in train]), return_counts=True)
    seen, of = lm_scoring.remembered(texts, held, nodes, n, len(train))
    at = 0
    for i, t in enumerate(texts):
        others = [x for j, x in enumerate(texts) if j != i and not held[j]]
        ends = lm_scoring.unit_ends(len(t))
        for k, e in enumerate(ends):
            start = int(ends[k - 1]) if k else 0
            alike = lambda x, e: int(e) in [0, *lm_scoring.unit_ends(len(x))] and x[:e].tolist() == t[:e].tolist()  # noqa: B023, E731
            assert seen[at] == sum(alike(x, e) for x in others) and of[at] == sum(alike(x, start) for x in others)
            at += 1
    assert at == len(seen)


def test_partitions_do_not_matter(spark, monkeypatch):
    """Equal rows from 1 and 7 partitions, with several shards, blocks and pieces."""
    monkeypatch.setattr(lm_scoring, "SHARD_IDS", 20_000)
    monkeypatch.setattr(lm_scoring, "PIECE_IDS", 500)
    monkeypatch.setattr(lm_scoring, "BLOCK_TEXT", 50_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 7").selectExpr("doc_id + 100000 AS doc_id", "text"))
    one, seven = (Counter(map(tuple, lm_scoring.scored(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == seven
    rows = {r[0]: r for r in one}
    assert rows[3][-1] > 0.3 * rows[6][-1] * rows[3][2] / rows[6][2]  # a repeated training text is remembered


def test_lm_base(spark, odd, none):
    rows = odd.collect()
    tokens = {i: (r.text or "").encode().lower().split() + [b" "] for i, r in enumerate(rows)}
    held = {i: lm_scoring.held_out(r.doc_id) for i, r in enumerate(rows)}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i]), 3)) for i, r in enumerate(rows))
    got = lm_scoring.scored(odd).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got) and lm_scoring.scored(none).count() == 0


def test_lm_layout(spark):
    texts = ["a b c d", "a b\n\tc  d", "a b c d\n", "a\xa0b C d"]
    rows = {r.doc_id: r for r in lm_scoring.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len({r.score for r in rows.values()}) == 4 and rows[0].base_score == rows[1].base_score == rows[2].base_score
    assert [rows[i].n_tokens for i in range(4)] == [5, 5, 5, 4]


def test_pieces_are_encoded_once(monkeypatch):
    """The ids are those of whole texts, whatever their white space; a block encodes what it repeats only once."""
    rng, path = np.random.default_rng(5), files()[1]
    some = ["a", "b ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " \u3000", "\u2028", "\u200b", "\u0301", "\xe9", "'s", " 's", "12 ", "!?", "\u4e2d\u6587", "\U0001f600", "<|endoftext|>", ""]
    texts = ["".join(rng.choice(some, int(rng.integers(0, 14)))) for _ in range(3000)] + ["the quick brown fox, " * 500] * 3
    encoding, encoded = packing._ranks(path), [0]

    def encode(text):
        encoded[0] += len(text)
        return encoding.encode_ordinary(text)

    monkeypatch.setattr(lm_scoring, "_ranks", lambda _: SimpleNamespace(encode_ordinary=encode, decode_single_token_bytes=encoding.decode_single_token_bytes))
    monkeypatch.setattr(lm_scoring, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    rows = [r for b in lm_scoring._learn_counts(path, 3)([batch]) for r in b.to_pylist()]
    got = {r["doc_id"]: np.frombuffer(r["data"], np.uint16).tolist() for r in rows if r["kind"] == 0}
    assert got == {i: [*encoding.encode_ordinary(t), lm_scoring.END] for i, t in enumerate(texts)}
    counts = Counter()
    for r in rows:
        if r["kind"] == 1:
            counts.update(dict(zip(r["data"].split(b"\n"), np.frombuffer(r["counts"], np.uint32).tolist(), strict=True)))
    want = Counter(w for i, t in enumerate(texts) if not lm_scoring.held_out(i) for w in t.encode().lower().split())
    assert +counts == want and set(counts) == {w for t in texts for w in t.encode().lower().split()}
    assert encoded[0] < sum(map(len, texts)) / 2
