"""The base against brute force; the model against a plain computation, and held-out texts against the base."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tidewatch.llm import attention_lm as lm

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def base(rows):
    tokens = [brute.words(t) + [None] for _, t in rows]
    counts = Counter(w for (i, _), t in zip(rows, tokens, strict=True) if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, _), t in zip(rows, tokens, strict=True):
        logs = [math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t]
        out.append((i, held(i), len(t), sum(counts[w] > 0 for w in t), n, math.fsum(logs)))
    return out


@pytest.mark.parametrize("head", [0, 40, 10**6])
def test_base(documents, odd_rows, head):
    got = lm.score_documents(documents(odd_rows), PATH, head).drop("score").collect()
    got, wanted = brute.ordered([tuple(r) for r in got]), brute.ordered(base(odd_rows))
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in wanted], rel=1e-9)


def test_nothing_to_learn_from(documents):
    assert lm.score_documents(documents([]), PATH).count() == 0
    i = next(i for i in range(99) if held(i))
    (row,) = lm.score_documents(documents([(i, "a b")]), PATH).collect()
    assert (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0.0)
    assert row.score < -9


def trained(texts):
    ranks = lm.read_ranks(PATH)
    encode, end = lm.subword_encoder(ranks), len(ranks)
    ids, starts, _, _ = lm.text_ids(lm.pa.array(texts), encode, end, {})
    return lm.train(ids, starts, np.bincount(ids, minlength=end + 1).astype(float), end), encode, end


def test_windows_score_each_token_once(odd_rows):
    model, encode, end = trained([t for _, t in odd_rows if t][:60])
    texts = ["", "one", " ".join(f"w{i % 7} x" for i in range(40))]
    ids, starts, _, _ = lm.text_ids(lm.pa.array(texts), encode, end, {})
    got = lm.log_probabilities(model, ids, starts, end)
    for a, b, total in zip(starts[:-1], starts[1:], got, strict=True):
        tokens = ids[a:b]
        assert tokens[-1] == end
        rows = model.row[np.r_[end, tokens[:-1]]]
        logs = 0.0
        for t, token in enumerate(tokens):
            window = np.arange(max(0, t // lm.BLOCK * lm.BLOCK - lm.BLOCK), t + 1)
            weights = np.exp(np.clip(model.k[rows[window]] @ model.q[rows[t]] + model.bias[t - window], -30, 30))
            scores = model.bigram[rows[t]] + (weights @ model.v[rows[window]] / weights.sum()) @ model.out
            logs += (scores[model.token_class[token]] - np.log(np.exp(scores).sum())) / np.log(10) + model.token_log[token]
        assert total == pytest.approx(logs, rel=1e-4)


def test_tokens_of_all_classes_sum_to_one(odd_rows):
    model, _, _ = trained([t for _, t in odd_rows if t][:30])
    assert np.bincount(model.token_class, 10**model.token_log, lm.CLASSES)[np.unique(model.token_class)] == pytest.approx(1)


def test_held_out_texts_beat_single_subwords(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts = [t for i, t in rows if not held(i)]
    model, encode, end = trained(texts)
    ids, starts, _, _ = lm.text_ids(lm.pa.array(texts), encode, end, {})
    counts = np.bincount(ids, minlength=end + 1) + 0.1
    other, other_starts, _, _ = lm.text_ids(lm.pa.array([t for i, t in rows if held(i)]), encode, end, {})
    single = np.log10(counts / counts.sum())[other].sum()
    assert lm.log_probabilities(model, other, other_starts, end).sum() > 0.75 * single


def test_model_learns_from_every_training_text(documents):
    """Texts whose ids have the largest hashes are no sample of 3,000; the order of their words is learned all the same."""
    frame = documents([(i, "") for i in range(3600) if not held(i)])
    ids = [r.doc_id for r in frame.selectExpr("doc_id", "xxhash64(doc_id) AS o").orderBy("o").collect()]
    assert len(ids) > 3100
    cycle = "red fox runs over cold stone while grey birds watch from high trees".split()
    rows = [(i, "one two") for i in ids[:-100]] + [(i, " ".join(cycle[(k + j) % len(cycle)] for j in range(40))) for k, i in enumerate(ids[-100:])]
    i = next(i for i in range(10**6, 2 * 10**6) if held(i))
    rows.append((i, " ".join(cycle * 3)))
    row = lm.score_documents(documents(rows), PATH).where(f"doc_id = {i}").first()
    assert row.score / row.n_tokens > -0.5


def test_many_texts_are_passed_over_as_often_as_few(spark, monkeypatch):
    """2.4 million tokens: each part of the texts is learned from ``EPOCHS`` times."""
    end, learned = 199, []
    text = np.random.default_rng(4).integers(0, end + 1, 100_000).astype(lm._id_type(end)).tobytes()
    texts = spark.createDataFrame([(i % lm.ROUNDS, bytearray(text)) for i in range(24)], "part int, ids binary").repartition(4, "part")

    def fitted(theta, tables, end, fit=lm._fitted):
        learned.append(theta.value.copy())
        return fit(theta, tables, end)

    monkeypatch.setattr(lm, "_fitted", fitted)
    lm._learn(texts, end)
    assert len(learned) == lm.EPOCHS * lm.ROUNDS
    assert all((a != b).any() for a, b in zip(learned[:-1], learned[1:], strict=True))


def test_parts_of_a_row_of_ids_and_vectors_meet():
    """Rows of a token that arrive in two batches make one vector; ids come back as they were."""
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array([1, 1, 2]), lm.pa.array([0, 5, 7]), lm.pa.array([9, 16, 4])], names=["token", "bucket", "n"])
    whole = [r for b in lm._vectors(iter([batch])) for r in b.to_pylist()]
    parts = [r for b in lm._vectors(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]
    assert whole == parts and [r["token"] for r in whole] == [1, 2]
    kind = lm._id_type(60000)
    texts = [np.array(x, kind) for x in ([5, 60000], [60000], [1, 2, 3, 60000])]
    ids, starts = lm._decoded(lm.pa.array([x.tobytes() for x in texts], lm.pa.binary()).slice(1), 60000)
    assert ids.tolist() == [60000, 1, 2, 3, 60000] and starts.tolist() == [0, 1, 5]


def test_texts_are_encoded_once(documents, monkeypatch):
    """Scores are made from the ids that training has read."""
    plans, staged = {}, lm.staged
    monkeypatch.setattr(lm, "staged", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and staged(df, name))
    rows = lm.score_documents(documents([(i, "a b c") for i in range(20)]), PATH).collect()
    assert len(rows) == 20 and "text#" in plans["subwords"] and "text#" not in plans["scores"]


def test_gradient_of_a_step_is_that_of_its_parts(monkeypatch):
    """Scores of a step need not fit a cache at once."""
    rng = np.random.default_rng(3)
    p, odds = lm._views(lm._initial(50)), rng.random((50, lm.CLASSES), np.float32) + 0.1
    p["out"][:] = rng.normal(0, 0.3, p["out"].shape)
    both, y, first = rng.integers(0, 50, (150, 2 * lm.BLOCK)), rng.integers(-1, lm.CLASSES, (150, lm.BLOCK)), rng.random(150) < 0.3
    parts = lm._gradient(p, odds, both, y, first, np.empty((2, lm.PART * lm.BLOCK, lm.CLASSES), np.float32))
    monkeypatch.setattr(lm, "PART", 150)
    whole = lm._gradient(p, odds, both, y, first, np.empty((2, 150 * lm.BLOCK, lm.CLASSES), np.float32))
    assert np.allclose(parts[0], whole[0], atol=1e-6)
    assert all(np.allclose(parts[1][name], whole[1][name], atol=1e-5) for name in whole[1])


def test_words_are_encoded_in_one_call():
    """Many words at once have the ids that each has alone, and words seen before are not encoded again."""
    import tiktoken

    ranks = lm.read_ranks(PATH)
    alone = tiktoken.Encoding("alone", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    words = ["a", "straße", "\u00a0", "x\u2028y\u3000z", "\U0001f600\u200d", "\u0301", "don't", "12.5%", "\x00\x1f", "é" * 700, "\u65e5\u672c\u8a9e", "<|endoftext|>"]
    encode, asked, memory = lm.subword_encoder(ranks), [], {}

    def counted(new):
        asked.append(new.to_pylist())
        return encode(new)

    for texts in (words[:7], [" \n".join(words), None, "a a"], ["", " "], words):
        ids, starts, _, _ = lm.text_ids(lm.pa.array(texts, lm.pa.string()), counted, len(ranks), memory)
        wanted = [[i for w in (t or "").split(" ") for i in alone.encode_ordinary(f" {w.strip(chr(10))}") if w.strip(" ")] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [w + [len(ranks)] for w in wanted]
    assert asked == [words[:7], words[7:], [], []]


def test_gradient_is_that_of_the_loss():
    """Against differences of a plain cross entropy, with padding and first blocks."""
    rng = np.random.default_rng(5)
    theta = lm._initial(9)
    p, odds = lm._views(theta), rng.random((9, lm.CLASSES), np.float32) + 0.1
    p["out"][:], p["bias"][:] = rng.normal(0, 0.3, p["out"].shape), rng.normal(0, 0.3, p["bias"].shape)
    both, y, first = rng.integers(0, 9, (40, 2 * lm.BLOCK)), rng.integers(0, lm.CLASSES, (40, lm.BLOCK)), rng.random(40) < 0.4
    y[rng.random(y.shape) < 0.3] = -1

    def loss(theta):
        p, total = lm._views(theta), 0.0
        for rows, targets, alone in zip(both, y, first, strict=True):
            x = p["e"][rows]
            for t in np.flatnonzero(targets >= 0):
                seen = slice(lm.BLOCK if alone else 0, lm.BLOCK + t + 1)
                w = np.exp(x[seen] @ p["k"] @ (x[lm.BLOCK + t] @ p["q"]) + p["bias"][lm.BLOCK + t - np.arange(2 * lm.BLOCK)[seen]])
                scores = np.log(odds[rows[lm.BLOCK + t]]) + w @ (x[seen] @ p["v"]) / w.sum() @ p["out"]
                total += np.log(np.exp(scores).sum()) - scores[targets[t]]
        return total / (y >= 0).sum()

    dx, d = lm._gradient(p, odds, both, y, first, np.empty((2, lm.PART * lm.BLOCK, lm.CLASSES), np.float32))
    got = np.zeros_like(theta)
    np.add.at(lm._views(got)["e"], both.ravel(), dx.reshape(-1, lm.WIDTH))
    for name, x in d.items():
        lm._views(got)[name][:] = x
    for _ in range(3):
        step = rng.normal(0, 1e-4, theta.shape)
        assert (got * step).sum() == pytest.approx(loss(theta + step / 2) - loss(theta - step / 2), rel=2e-3)
