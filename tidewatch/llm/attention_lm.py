"""Scores of a causal language model with self-attention over subword ids, beside a word-count base.

The model reads subword ids (vocabulary file as a parameter). A token's class is predicted from the token before it and from causal self-attention
over the context; the token within its class comes from counts over all training texts. Text is cut into windows of two blocks of ``BLOCK`` tokens that
overlap by one: each window scores its second block, the first being context, so every token is scored once. Windows go through
masked attention in batches.

All of the model is learned from all training texts. The ids of all texts are written once, for training and scoring. Pairs of neighbouring tokens are counted by Spark: these counts give
the clusters of tokens (k-means, a Spark job a round), the context rows and the class scores per row. The attention is trained in ``EPOCHS`` passes of ``ROUNDS`` rounds
that share the texts out by hash of the id: each task goes on from the round's parameters with Adam over its texts, and the round ends with the mean over
tasks, weighted by tokens (a context row's by its occurrences). What the driver holds is bounded by the vocabulary.

Word counts come from all training texts. The most frequent words, at most ``HEAD``, are broadcast (a bounded table, most of all tokens); the rest
joins by word, and without the frequent words no key of that join is hot.

Defined results: a null or empty text is just its end. A null id is in the training part. Rows are scored one by one, repeated rows count as often in
training. With nothing to learn from, subwords are equally likely. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import pick, staged
from tidewatch.llm.textops import LOWER, SPACE, chunks, flat, word_bounds

BLOCK = 16
#: Windows that go through attention at a time.
BATCH = 128
CLASSES = 192
SINGLE = 112
WIDTH = 16
HEAD = 200_000
REMEMBERED = 150_000
#: Passes over the training texts, however many there are.
EPOCHS = 2
#: Parts of a pass; tasks' parameters are averaged after each.
ROUNDS = 4
#: A token in the training texts this often has a row of its own as context; others share the row of their class.
OWN_ROW = 3
#: Hashed neighbours on either side by which tokens are clustered.
BUCKETS = 256
#: Bytes of ids that a task handles at once when it counts pairs.
PAIR_BYTES = 4 << 20
#: Windows in a step of training, and in a part of a step or a batch, whose class scores stay in a core's cache.
STEP, PART = 384, 16
#: Split before merges: at the blank before each word, so that words, which have none, are encoded whole.
PATTERN = r"\x20[^\x20]+"


@dataclass
class Model:
    token_class: np.ndarray
    token_log: np.ndarray  # log10 P(token | class)
    row: np.ndarray  # context row of each token
    q: np.ndarray  # tables per row
    k: np.ndarray
    v: np.ndarray
    bigram: np.ndarray  # class scores per row
    out: np.ndarray
    bias: np.ndarray  # by distance

    @cached_property
    def odds(self) -> np.ndarray:
        return np.exp(self.bigram)

    def __getstate__(self) -> dict:
        return {name: x for name, x in self.__dict__.items() if name != "odds"}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def subword_encoder(ranks: dict[bytes, int]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Encodes many words in one call: all their ids, and the number of each word's."""
    import tiktoken

    encoding = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
    n_bytes[list(ranks.values())] = list(map(len, ranks))

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), " ")
        ids = np.array(encoding.encode_ordinary(" " + joined[0].as_py()), np.int64)
        # An id stands for bytes, so a word ends where the bytes so far are those of the words so far.
        ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        return ids, np.diff(np.searchsorted(np.cumsum(n_bytes[ids]), ends) + 1, prepend=0)

    return encode


def _mask() -> tuple[np.ndarray, np.ndarray]:
    """Distance of each query to each key of a window, and a one for each pair that is causal."""
    distance = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
    return np.maximum(distance, 0), (distance >= 0).astype(np.float32)


def _blocks(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded blocks of context and target ids of texts (each closed by ``end``); targets are -1 in the padding.

    Also the text of each block, and whether it is the first of its text.
    """
    lengths = np.diff(starts)
    counts = -(-lengths // BLOCK)
    first_block = np.cumsum(counts) - counts
    place = np.arange(len(ids)) - np.repeat(starts[:-1], lengths) + np.repeat(first_block * BLOCK, lengths)
    target = np.full(int(counts.sum()) * BLOCK, -1, np.int64)
    target[place] = ids
    context = np.full(len(target) + 1, end, np.int64)
    context[1:] = np.where(target >= 0, target, end)
    context = context[:-1]
    first = np.zeros(len(target) // BLOCK, bool)
    first[first_block[counts > 0]] = True
    context = context.reshape(-1, BLOCK)
    context[first, 0] = end
    return context, target.reshape(-1, BLOCK), np.repeat(np.arange(len(lengths)), counts), first


def _weights(q, keys, bias, causal, first):
    """Weights of attention before they are divided by their sum, for a batch of windows."""
    scores = np.matmul(q, keys.transpose(0, 2, 1))
    scores += bias
    np.clip(scores, -30, 30, out=scores)
    np.exp(scores, out=scores)
    scores *= causal
    scores[first, :, :BLOCK] = 0
    return scores


def _windows(x: np.ndarray) -> np.ndarray:
    """Each block after the one before it, as a view."""
    block, step, item = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(x) - 1, 2 * BLOCK, x.shape[2]), (block, step, item), writeable=False)


def log_probabilities(model: Model, ids: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """log10 probability of each text."""
    context, target, owner, first = _blocks(ids, starts, end)
    distance, causal = _mask()
    bias = model.bias[distance]
    # The block before the first one is any: the first of a text does not see it.
    rows = model.row[np.concatenate([context[:1], context])]
    # Values end in a one, so that weighted values end in the sum of weights.
    tables = np.concatenate([model.q, model.k, model.v, np.ones((len(model.v), 1), np.float32)], axis=1)
    room = np.empty((2, PART * BLOCK, CLASSES), np.float32)
    known = np.maximum(target, 0)
    classes, per_token = model.token_class[known], np.empty(target.shape)
    for a in range(0, len(target), BATCH):
        part = slice(a, a + BATCH)
        x = tables.take(rows[a : a + BATCH + 1], axis=0)
        keys, values = _windows(x[:, :, WIDTH : 2 * WIDTH]), _windows(x[:, :, 2 * WIDTH :])
        seen = np.matmul(_weights(x[1:, :, :WIDTH], keys, bias, causal, first[part]), values).reshape(-1, WIDTH + 1)
        logs = _class_logs(model, seen[:, :WIDTH] / seen[:, WIDTH:], rows[1:][part].ravel(), classes[part].ravel(), room)
        per_token[part] = logs.reshape(-1, BLOCK)
    per_token = np.where(target < 0, 0, per_token / np.log(10) + model.token_log[known])
    return np.bincount(owner, per_token.sum(axis=1), len(starts) - 1)


def _class_logs(model: Model, seen: np.ndarray, rows: np.ndarray, classes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Natural logs of the probabilities of ``classes`` after context rows, with what the attention has seen."""
    logs, whole = model.bigram.ravel().take(rows * CLASSES + classes).astype(float), np.empty(len(rows), np.float32)
    size = PART * BLOCK
    place = classes + np.arange(len(rows)) % size * CLASSES
    for a in range(0, len(rows), size):
        at = slice(a, a + size)
        x = seen[at]
        scores, factors = room[:, : len(x)]
        np.matmul(x, model.out, out=scores)
        logs[at] += scores.ravel().take(place[at])
        # exp(bigram + scores) without a sum per class: the first factor is a table.
        np.exp(scores, out=scores)
        model.odds.take(rows[at], axis=0, out=factors, mode="clip")
        np.vecdot(scores, factors, out=whole[at])
    return logs - np.log(whole)


def _single_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the frequent tokens, each its own, and of those not seen; the other tokens, most frequent first, which are to be clustered."""
    order = np.argsort(-counts, kind="stable")
    classes = np.full(len(counts), SINGLE - 1)
    classes[order[: SINGLE - 1]] = np.arange(SINGLE - 1)
    rest = order[SINGLE - 1 :]
    return classes, rest[counts[rest] > 0]


def _buckets(size: int) -> np.ndarray:
    return np.random.default_rng(1).integers(0, BUCKETS, size)


def _directions(token: np.ndarray, bucket: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Unit vectors of tokens (numbered from 0) from how often each neighbour is seen beside them."""
    x = np.sqrt(np.bincount(token * 2 * BUCKETS + bucket, n, size * 2 * BUCKETS)).astype(np.float32).reshape(size, -1)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
    return x


def _cluster_sums(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    near = (x @ centers.T).argmax(axis=1)
    return np.stack([x[near == c].sum(axis=0) for c in range(len(centers))])


def _centers(centers: np.ndarray, sums_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """k-means on the sphere; ``sums_of``: sums of the vectors nearest to each center."""
    for _ in range(12):
        sums = sums_of(centers)
        lengths = np.linalg.norm(sums, axis=1)
        alive = lengths > 0
        centers = centers.copy()
        centers[alive] = sums[alive] / lengths[alive, None]
    return centers


def _rows(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Context row of each token, and the number of rows."""
    own = np.flatnonzero(counts >= OWN_ROW)
    row = classes.copy()
    row[own] = CLASSES + np.arange(len(own))
    return row, CLASSES + len(own)


def _bigram(pairs: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class scores of rows from the counts of classes after them."""
    overall = np.bincount(classes, counts, CLASSES) + 0.5
    overall = (overall / overall.sum()).astype(np.float32)
    return np.log((pairs + 5 * overall) / (pairs.sum(axis=1, keepdims=True) + 5)).astype(np.float32)


def _token_log(classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    smooth = counts + 0.1
    return np.log10(smooth / np.bincount(classes, smooth, CLASSES)[classes])


def pair_counts(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a token and the one before it, as one number, and how often they occur; the first of a text stands after an end."""
    return np.unique(np.r_[end, ids[:-1]] * (end + 1) + ids, return_counts=True)


def _views(theta: np.ndarray) -> dict[str, np.ndarray]:
    """All parameters of the attention are one table of ``WIDTH`` columns: context rows first."""
    n = len(theta) - _OTHERS
    at = n + CLASSES
    square = {name: theta[at + i * WIDTH : at + (i + 1) * WIDTH] for i, name in enumerate("qkv")}
    return {"e": theta[:n], "out": theta[n:at].reshape(WIDTH, CLASSES), "bias": theta[at + 3 * WIDTH :].reshape(-1)} | square


#: Rows of the table that are no context rows.
_OTHERS = CLASSES + 3 * WIDTH + 2 * BLOCK // WIDTH


def _initial(n_rows: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    theta = np.zeros((n_rows + _OTHERS, WIDTH), np.float32)
    p = _views(theta)
    p["e"][:] = rng.normal(0, 0.5, p["e"].shape)
    for name in "qkv":
        p[name][:] = rng.normal(0, 0.25, p[name].shape)
    return theta


def _gradient(p: dict[str, np.ndarray], odds: np.ndarray, both: np.ndarray, y: np.ndarray, first: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of the cross entropy of classes, for windows of context rows ``both``: for their rows, and for the other parameters."""
    distance, causal = _mask()
    x = p["e"].take(both, axis=0)
    now = np.ascontiguousarray(x[:, BLOCK:])
    # Keys and values side by side, and what comes back to them.
    to_both = np.concatenate([p["k"], p["v"]], axis=1)
    q, kv = (now.reshape(-1, WIDTH) @ p["q"]).reshape(now.shape), (x.reshape(-1, WIDTH) @ to_both).reshape(*both.shape, 2 * WIDTH)
    keys, values = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
    w = _weights(q, keys, p["bias"][distance], causal, first)
    # The weights stay undivided; their sums divide what is seen and what comes back to it.
    sums = (w.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, np.float32))[:, None]
    seen = np.matmul(w, values).reshape(-1, WIDTH)
    seen /= sums
    dseen, d_out = _class_errors(p["out"], odds, seen, both[:, BLOCK:].ravel(), y.ravel(), room)
    dseen /= sums
    d, back = {"out": d_out}, dseen.reshape(now.shape)
    dw = np.matmul(back, values.transpose(0, 2, 1))
    dw -= ((dseen * seen) @ np.ones(WIDTH, np.float32)).reshape(*w.shape[:2], 1)
    dw *= w
    d["bias"] = np.bincount(distance.ravel(), dw.sum(axis=0).ravel(), 2 * BLOCK).astype(np.float32)
    dq, dkv = np.matmul(dw, keys).reshape(-1, WIDTH), np.empty_like(kv)
    np.matmul(dw.transpose(0, 2, 1), q, out=dkv[:, :, :WIDTH])
    np.matmul(w.transpose(0, 2, 1), back, out=dkv[:, :, WIDTH:])
    d["q"] = now.reshape(-1, WIDTH).T @ dq
    d["k"], d["v"] = np.split(np.matmul(x.transpose(0, 2, 1), dkv).sum(axis=0), 2, axis=1)
    dx = (dkv.reshape(-1, 2 * WIDTH) @ to_both.T).reshape(x.shape)
    dx[:, BLOCK:] += (dq @ p["q"].T).reshape(now.shape)
    return dx, d


def _class_errors(out, odds, seen, rows, y, room) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of what the attention has seen and of the class vectors ``out``; ``y`` is -1 where there is no target."""
    dseen, d_out, back, ones = np.empty_like(seen), np.zeros_like(out), np.ascontiguousarray(out.T), np.ones(CLASSES, np.float32)
    scale = (y >= 0).astype(np.float32)[:, None] / np.float32(max(1, np.count_nonzero(y >= 0)))
    size = PART * BLOCK
    place = np.maximum(y, 0) + np.arange(len(y)) % size * CLASSES
    for a in range(0, len(seen), size):
        at = slice(a, a + size)
        x = seen[at]
        g, factors = room[:, : len(x)]
        np.matmul(x, out, out=g)
        np.exp(g, out=g)
        odds.take(rows[at], axis=0, out=factors, mode="clip")
        g *= factors
        whole = g @ ones
        g.reshape(-1)[place[at]] -= whole
        # Errors are g divided by its sums: the division is left to the narrow sides of the products.
        scale[at] /= whole[:, None]
        np.matmul(g, back, out=dseen[at])
        d_out += (x * scale[at]).T @ g
    dseen *= scale
    return dseen, d_out


class Fit:
    """Adam from ``theta`` on; moments of context rows move when the rows occur."""

    def __init__(self, theta: np.ndarray, row: np.ndarray, classes: np.ndarray, odds: np.ndarray, end: int):
        self.theta, self.row, self.classes, self.odds, self.end = theta.copy(), row, classes, odds, end
        self.p, self.n_rows = _views(self.theta), len(theta) - _OTHERS
        self.m, self.s = np.zeros_like(theta), np.zeros_like(theta)
        #: How often each row of the table was used.
        self.used, self.steps, self.rng = np.zeros(len(theta), np.int64), 0, np.random.default_rng(2)
        self.room = np.empty((2, PART * BLOCK, CLASSES), np.float32)

    def learn(self, ids: np.ndarray, starts: np.ndarray) -> None:
        context, target, _, first = _blocks(ids, starts, self.end)
        rows = self.row[context]
        y = np.where(target >= 0, self.classes[np.maximum(target, 0)], -1)
        self.used[: self.n_rows] += np.bincount(rows[target >= 0], minlength=self.n_rows)
        self.used[self.n_rows :] += len(ids)
        order = self.rng.permutation(len(rows))
        for a in range(0, len(order), STEP):
            at = order[a : a + STEP]
            both = np.concatenate([rows[np.maximum(at - 1, 0)], rows[at]], axis=1)
            dx, d = _gradient(self.p, self.odds, both, y[at], first[at], self.room)
            # Numbers of two bytes, which rows mostly are, are sorted by radix.
            places = both.astype(np.min_scalar_type(self.n_rows)).ravel()
            by_row = places.argsort(kind="stable")
            places = places[by_row]
            begin = np.r_[0, np.flatnonzero(places[1:] != places[:-1]) + 1]
            seen = places[begin].astype(np.int64)
            moved = np.add.reduceat(dx.reshape(-1, WIDTH).take(by_row, axis=0), begin, axis=0)
            rest = np.concatenate([d[name].reshape(-1, WIDTH) for name in ("out", "q", "k", "v", "bias")])
            self._move(np.r_[seen, np.arange(self.n_rows, len(self.theta))], np.concatenate([moved, rest]))

    def _move(self, at: np.ndarray, g: np.ndarray) -> None:
        self.steps += 1
        m, s = self.m[at], self.s[at]
        m += 0.1 * (g - m)
        s += 0.01 * (g**2 - s)
        self.m[at], self.s[at] = m, s
        self.theta[at] -= 0.01 * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-8)


def _model(theta: np.ndarray, classes: np.ndarray, row: np.ndarray, counts: np.ndarray, bigram: np.ndarray) -> Model:
    p = _views(theta)
    return Model(classes, _token_log(classes, counts), row, p["e"] @ p["q"], p["e"] @ p["k"], p["e"] @ p["v"], bigram, p["out"], p["bias"])


def train(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, end: int, seed: int = 1) -> Model:
    """The model of a few texts, as ``learn`` has it of a table. ``counts``: of each token in them."""
    key, n = pair_counts(ids, end)
    before, after = np.divmod(key, end + 1)
    classes, rest = _single_classes(counts)
    if len(rest):
        place = np.full(end + 1, -1)
        place[rest] = np.arange(len(rest))
        token, bucket = np.r_[after, before], np.r_[_buckets(end + 1)[before], BUCKETS + _buckets(end + 1)[after]]
        kept = place[token] >= 0
        x = _directions(place[token[kept]], bucket[kept], np.r_[n, n][kept], len(rest))
        centers = _centers(x[np.arange(CLASSES - SINGLE) % len(x)], lambda centers: _cluster_sums(x, centers))
        classes[rest] = SINGLE + (x @ centers.T).argmax(axis=1)
    row, n_rows = _rows(classes, counts)
    pairs = np.bincount(row[before] * CLASSES + classes[after], n, n_rows * CLASSES).reshape(n_rows, CLASSES)
    bigram = _bigram(pairs, classes, counts)
    fit = Fit(_initial(n_rows, seed), row, classes, np.exp(bigram), end)
    for _ in range(EPOCHS):
        fit.learn(ids, starts)
    return _model(fit.theta, classes, row, counts, bigram)


def uniform(vocabulary: int) -> Model:
    """The model of nothing learned."""
    zero = np.zeros((1, WIDTH), np.float32)
    return Model(
        np.zeros(vocabulary, np.int64), np.full(vocabulary, np.log10(CLASSES / vocabulary)), np.zeros(vocabulary, np.int64),
        zero, zero, zero, np.zeros((1, CLASSES), np.float32), np.zeros((WIDTH, CLASSES), np.float32), np.zeros(2 * BLOCK, np.float32),
    )


def _coded_words(text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    data, starts = flat(text)
    data = LOWER[data]
    first, end, bounds = word_bounds(data, starts)
    # All words are taken, so their bytes are those that are no blanks.
    offsets, joined = np.r_[0, np.cumsum(end - first)], data[~SPACE[data]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    return words.cast(pa.large_string()).dictionary_encode(), bounds


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", 4 << 20):
        coded, _ = _coded_words(batch.column("text"))
        counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(counts)], names=["word", "n"])


def _word_ids(words: pa.Array, encode, memory: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of ids of each word, where they start in a table of ids, and that table; ``memory`` has those of words seen before."""
    if not memory or len(memory["words"][0]) > REMEMBERED:
        memory["words"] = (words.slice(0, 0), *(np.zeros(0, np.int64) for _ in range(3)))
    known, sizes, at, table = memory["words"]
    place = pc.fill_null(pc.index_in(words, known), -1).to_numpy().astype(np.int64)
    new = place < 0
    found = words.filter(pa.array(new))
    ids, n = encode(found)
    place[new] = len(known) + np.arange(len(found))
    sizes, at, table = np.r_[sizes, n], np.r_[at, len(table) + np.cumsum(n) - n], np.r_[table, ids]
    memory["words"] = (pa.concat_arrays([known, found]), sizes, at, table)
    return sizes[place], at[place], table


def text_ids(text: pa.Array, encode, end: int, memory: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Subword ids of all texts, each closed by ``end``, and where they start; the coded words and where those start."""
    coded, bounds = _coded_words(text)
    sizes, at, table = _word_ids(coded.dictionary, encode, memory)
    codes = coded.indices.to_numpy()
    n = sizes[codes]
    before = np.r_[0, np.cumsum(n)]
    starts = before[bounds] + np.arange(len(bounds))
    place = np.arange(int(before[-1]))
    inner = table[np.repeat(at[codes] - before[:-1], n) + place]
    ids = np.full(int(starts[-1]), end, np.int64)
    # Each text is moved by one for the end of each text before it.
    ids[place + np.repeat(np.arange(len(bounds) - 1), np.diff(before[bounds]))] = inner
    return ids, starts, coded, bounds


def _coded(ranks, head, end_count: int):
    """Ids of each text, and its base as far as the frequent words go."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, memory = subword_encoder(ranks.value), len(ranks.value), {}
        counts = dict(zip(*(head.value.column(c).to_numpy().tolist() for c in ("word", "n")), strict=True))
        end_log = np.log10(end_count + 0.1)
        for batch in chunks(batches, "text"):
            ids, starts, coded, bounds = text_ids(batch.column("text"), encode, end, memory)
            ids = ids.astype(_id_type(end))
            offsets = pa.py_buffer((starts * ids.itemsize).astype(np.int32))
            words, codes = coded.dictionary, coded.indices.to_numpy()
            known = np.fromiter((counts.get(w, -1) for w in words.to_numpy(zero_copy_only=False).tolist()), np.int64, len(words))
            n = known[codes] if len(words) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            in_head = n >= 0
            base = np.bincount(owner[in_head], np.log10(n[in_head] + 0.1), batch.num_rows)
            # Words outside the head: each once per text, with its number.
            key, times = np.unique(owner[~in_head] * max(1, len(words)) + codes[~in_head], return_counts=True)
            lists = pa.array(np.searchsorted(key // max(1, len(words)), np.arange(batch.num_rows + 1)), pa.int32())
            tail = pa.ListArray.from_arrays(lists, words.take(pa.array(key % max(1, len(words)))).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("part"), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(ids)]),
                    pa.array(np.diff(bounds) + 1), pa.array(base + end_log),
                    pa.array(np.bincount(owner[in_head], minlength=batch.num_rows) + int(end_count > 0)),
                    tail, pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int64))),
                ],
                names=["doc_id", "part", "ids", "n_tokens", "head_log", "head_known", "words", "times"],
            )

    return code


def _scorer(model, end: int):
    """The score of each text from its ids; the other columns are passed on."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "ids"):
            logs = log_probabilities(model.value, *_decoded(batch.column("ids"), end), end)
            kept = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(logs)], names=[*kept, "score"])

    return score


def fold(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def _id_type(end: int) -> np.dtype:
    return np.min_scalar_type(end)


def _decoded(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a batch, and where each starts."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) // _id_type(end).itemsize
    ids = np.frombuffer(b"".join(column.to_pylist()), _id_type(end)).astype(np.int64)
    return ids, np.r_[0, np.cumsum(sizes)]


def _count_pairs(end: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "ids", PAIR_BYTES):
            key, n = pair_counts(_decoded(batch.column("ids"), end)[0], end)
            yield pa.RecordBatch.from_arrays([*map(pa.array, np.divmod(key, end + 1)), pa.array(n)], names=["a", "b", "n"])

    return count


def _beside(place, buckets):
    """(token, bucket, n) of the tokens to be clustered, for both neighbours."""

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy() for c in "abn")
            for token, bucket in ((b, buckets[a]), (a, BUCKETS + buckets[b])):
                kept = place.value[token] >= 0
                yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (token, bucket, n)], names=["token", "bucket", "n"])

    return beside


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per token from rows sorted by token."""
    rest = None
    for batch in batches:
        got = np.stack([batch.column(c).to_numpy() for c in ("token", "bucket", "n")])
        got = got if rest is None else np.concatenate([rest, got], axis=1)
        last = got[0] == got[0, -1]
        rest = got[:, last]
        yield from _vector_rows(got[:, ~last])
    if rest is not None:
        yield from _vector_rows(rest)


def _vector_rows(got: np.ndarray) -> Iterator[pa.RecordBatch]:
    if got.shape[1]:
        tokens, number = np.unique(got[0], return_inverse=True)
        x = _directions(number, got[1], got[2], len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array([v.tobytes() for v in x], pa.binary())], names=["token", "x"])


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _partial_sums(centers: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centers)
        for batch in batches:
            total += _cluster_sums(_matrix(batch.column("x"), 2 * BUCKETS), centers)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    return sums


def _nearest(centers: np.ndarray):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_matrix(batch.column("x"), 2 * BUCKETS) @ centers.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(near)], names=["token", "c"])

    return nearest


def _clustered(pairs: DataFrame, rest: np.ndarray, size: int) -> np.ndarray:
    """Cluster of each token of ``rest``, from the counts of its neighbours."""
    spark = pairs.sparkSession
    place = np.full(size, -1)
    place[rest] = np.arange(len(rest))
    found = pairs.mapInArrow(_beside(spark.sparkContext.broadcast(place), _buckets(size)), "token long, bucket long, n long")
    found = found.groupBy("token", "bucket").agg(F.sum("n").alias("n")).repartition("token").sortWithinPartitions("token", "bucket")
    vectors = staged(found.mapInArrow(_vectors, "token long, x binary"), "token-vectors")
    first = vectors.where(F.col("token").isin([int(t) for t in rest[: CLASSES - SINGLE]])).collect()
    first = np.stack([np.frombuffer(r.x, np.float32) for r in sorted(first, key=lambda r: place[r.token])])

    def sums_of(centers: np.ndarray) -> np.ndarray:
        parts = vectors.mapInArrow(_partial_sums(centers), "x binary").collect()
        return np.sum([np.frombuffer(r.x, np.float32).reshape(centers.shape) for r in parts], axis=0)

    centers = _centers(first[np.arange(CLASSES - SINGLE) % len(first)], sums_of)
    clusters = np.zeros(len(rest), np.int64)
    for r in vectors.mapInArrow(_nearest(centers), "token long, c long").collect():
        clusters[place[r.token]] = r.c
    return clusters


def _class_pairs(tokens):
    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, row = tokens.value
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in "ab")
            yield pa.RecordBatch.from_arrays([pa.array(row[a]), pa.array(classes[b]), batch.column("n")], names=["row", "c", "n"])

    return classed


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, counts of the classes after it as float32), a part of it in each batch."""
    for batch in batches:
        rows, number = np.unique(batch.column("row").to_numpy(), return_inverse=True)
        n = np.bincount(number * CLASSES + batch.column("c").to_numpy(), batch.column("n").to_numpy(), len(rows) * CLASSES)
        n = n.astype(np.float32).reshape(-1, CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([x.tobytes() for x in n], pa.binary())], names=["row", "x"])


def _pair_table(pairs: DataFrame, classes: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    tokens = pairs.sparkSession.sparkContext.broadcast((classes, row))
    counts = pairs.mapInArrow(_class_pairs(tokens), "row long, c long, n long").groupBy("row", "c").agg(F.sum("n").alias("n"))
    found = counts.repartition("row").sortWithinPartitions("row").mapInArrow(_count_rows, "row long, x binary").toArrow()
    table = np.zeros((n_rows, CLASSES), np.float32)
    for batch in found.to_batches():
        # A row's counts may be in two batches.
        np.add.at(table, batch.column("row").to_numpy(), _matrix(batch.column("x"), CLASSES))
    return table


def _fitted(theta, tables, end: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, classes, odds = tables.value
        own = None
        for batch in chunks(batches, "ids"):
            own = own or Fit(theta.value, row, classes, odds, end)
            own.learn(*_decoded(batch.column("ids"), end))
        if own:
            at = np.flatnonzero(own.used)
            values = pa.array([x.tobytes() for x in own.theta[at]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.used[at]), values], names=["at", "n", "x"])

    return fit


def _averaged(size: int):
    """Means of the tasks' rows, weighted by ``n``."""

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros((size, WIDTH)), np.zeros(size)
        for batch in batches:
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            np.add.at(total, at, _matrix(batch.column("x"), WIDTH) * n[:, None])
            np.add.at(weight, at, n)
        at = np.flatnonzero(weight)
        values = (total[at] / weight[at, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([x.tobytes() for x in values], pa.binary())], names=["at", "x"])

    return average


def _learn(texts: DataFrame, end: int) -> Model:
    """From all of ``texts`` (part, ids)."""
    broadcast = texts.sparkSession.sparkContext.broadcast
    pairs = texts.select("ids").mapInArrow(_count_pairs(end), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = staged(pairs, "subword-pairs")
    counts = np.zeros(end + 1)
    for r in pairs.groupBy("b").agg(F.sum("n").alias("n")).collect():
        counts[r.b] = r.n
    if not counts.any():
        return uniform(end + 1)
    classes, rest = _single_classes(counts)
    if len(rest):
        classes[rest] = SINGLE + _clustered(pairs, rest, end + 1)
    row, n_rows = _rows(classes, counts)
    bigram = _bigram(_pair_table(pairs, classes, row, n_rows), classes, counts)
    theta, tables = _initial(n_rows), broadcast((row, classes, np.exp(bigram)))
    for k in range(EPOCHS * ROUNDS):
        now = broadcast(theta)
        fitted = texts.where(F.col("part") == k % ROUNDS).select("ids").mapInArrow(_fitted(now, tables, end), "at long, n long, x binary")
        found = fitted.repartition("at").mapInArrow(_averaged(len(theta)), "at long, x binary").toArrow()
        theta = theta.copy()
        if found.num_rows:
            theta[found.column("at").to_numpy()] = _matrix(found.column("x"), WIDTH)
        now.destroy()
    tables.destroy()
    return _model(theta, classes, row, counts, bigram)


def _frequent(counts: DataFrame, head: int) -> pa.Table:
    """The most frequent words, at most ``head``; words that are equally frequent are all in it or all left out."""
    least, taken = None, 0
    # A row per distinct count: at most the square root of twice the number of words.
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():
        taken += r.words
        if taken > head:
            break
        least = r.n
    return counts.where(F.lit(False) if least is None else F.col("n") >= least).select("word", "n").toArrow()


def score_documents(docs: DataFrame, vocabulary_path: str, head: int = HEAD) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = pick(docs, doc_id="doc_id", text="text")
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    id_type = docs.schema["doc_id"].dataType.simpleString()
    training = docs.where(~fold())
    counts = training.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = staged(counts, "word-counts")
    end_count = training.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] + end_count, total["v"] + (end_count > 0)
    ranks = broadcast(read_ranks(vocabulary_path))
    end = len(ranks.value)
    part = F.when(~fold(), F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(ROUNDS)).cast("int")).alias("part")
    base = f"doc_id {id_type}, part int, ids binary, n_tokens long, head_log double, head_known long, words array<string>, times array<bigint>"
    coded = docs.select("doc_id", part, "text").mapInArrow(_coded(ranks, broadcast(_frequent(counts, head)), end_count), base)
    coded = staged(coded, "subwords")
    model = broadcast(_learn(coded.where("part IS NOT NULL").select("part", "ids"), end))
    schema = f"{base.replace(', part int, ids binary', '')}, score double"
    scored = coded.drop("part").mapInArrow(_scorer(model, end), schema)
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    tail = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    tail = tail.join(counts.withColumnRenamed("word", "words"), "words", "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("tail_log"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
    )
    whole = float(np.log10(n + 0.1 * (v + 1)))
    return scored.drop("words", "times").join(tail, "row", "left").select(
        "doc_id", fold().alias("held_out"), "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        "score",
    )
