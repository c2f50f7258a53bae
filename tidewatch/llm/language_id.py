"""Language ID by a byte convolutional network.

Text is cut into windows of ``WINDOW`` bytes. Filters of several widths slide over the embedded bytes of a window; each filter
keeps its largest value in the window (max pooling), and a softmax over these gives the languages. A text's score
is the mean of the probabilities of its windows, weighted by their letters. Trained here in numpy on about
``SAMPLE_PER_LANGUAGE`` labelled texts per language, one window each, chosen by hash of the id. In the scan the
product of embedding and filter is looked up per pair of bytes, which gives the same sums as the
convolution.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every text if there is nothing to learn
from. Rows are scored one by one, so repeated rows and null ids are no case of their own. Extra columns are kept by
``with_language`` and ignored by ``language_report``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.tables import pick
from tidewatch.llm.textops import LOWER, chunks, flat

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 4)
FILTERS = 24
EMBEDDING = 12
SAMPLE_PER_LANGUAGE = 2000
#: Labelled rows that a network is fitted on; with many languages each gives fewer, but one at least.
SAMPLE_ROWS = 512_000
EPOCHS = 4


@dataclass
class Network:
    """Pair tables of the filters, biases, output layer and the languages' names."""

    languages: list[str]
    pairs: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _windows(text: str, seed: int) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    start = seed % max(1, len(data) - WINDOW + 1)
    window = np.zeros(WINDOW, np.uint8)
    part = data[start : start + WINDOW]
    window[: len(part)] = part
    return window


def train(texts: list[str], labels: list[str], seed: int = 1) -> Network:
    """Adam on the cross entropy of windows; gradients of max pooling go to the place of the maximum."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    x = np.stack([_windows(t, int(rng.integers(0, 1 << 30))) for t in texts])
    # Short texts are common; some windows are cut so that they are learned too.
    cut = rng.random(len(x)) < 0.3
    for i in np.flatnonzero(cut):
        x[i, rng.integers(12, WINDOW) :] = 0
    n_features = FILTERS * len(WIDTHS)
    p = {
        "embedding": rng.normal(0, 0.5, (256, EMBEDDING)),
        "out": rng.normal(0, 0.1, (n_features, len(languages))),
        "bias": np.zeros(n_features),
        "out_bias": np.zeros(len(languages)),
    }
    for w in WIDTHS:
        p[f"filter{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, batch = 0, 64
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            xb = x[rows]
            e = p["embedding"][xb]
            pooled, places = [], []
            for w in WIDTHS:
                seen = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)
                seen = seen.transpose(0, 1, 3, 2).reshape(len(rows), WINDOW - w + 1, w * EMBEDDING)
                z = seen @ p[f"filter{w}"]
                places.append(z.argmax(axis=1))
                pooled.append(np.take_along_axis(z, places[-1][:, None], axis=1)[:, 0])
            z = np.concatenate(pooled, axis=1) + p["bias"]
            h = np.maximum(z, 0)
            logits = h @ p["out"] + p["out_bias"]
            q = np.exp(logits - logits.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(rows)), y[rows]] -= 1
            q /= len(rows)
            g = {"out": h.T @ q, "out_bias": q.sum(axis=0)}
            dz = (q @ p["out"].T) * (z > 0)
            g["bias"] = dz.sum(axis=0)
            g["embedding"] = np.zeros_like(p["embedding"])
            for k, w in enumerate(WIDTHS):
                d = dz[:, k * FILTERS : (k + 1) * FILTERS]
                at = places[k][:, :, None] + np.arange(w)
                bytes_at = np.take_along_axis(xb, at.reshape(len(rows), -1), axis=1).reshape(at.shape)
                seen = p["embedding"][bytes_at].reshape(len(rows), FILTERS, w * EMBEDDING)
                g[f"filter{w}"] = np.einsum("bf,bfe->ef", d, seen)
                back = (d[:, :, None] * p[f"filter{w}"].T[None]).reshape(-1, EMBEDDING)
                np.add.at(g["embedding"], bytes_at.reshape(-1), back)
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    pairs = []
    for w in WIDTHS:
        f = p[f"filter{w}"].reshape(w, EMBEDDING, FILTERS)
        single = [p["embedding"] @ f[i] for i in range(w)]
        for i in range(0, w, 2):
            pairs.append((single[i][:, None] + single[i + 1][None]).reshape(65536, FILTERS).astype(np.float32))
    return Network(languages, pairs, p["bias"], p["out"], p["out_bias"])


def probabilities(network: Network, windows: np.ndarray) -> np.ndarray:
    """Softmax of each row of ``windows`` (bytes, padded with zeros)."""
    code = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
    pooled, table = [], 0
    for w in WIDTHS:
        span = WINDOW - w + 1
        z = network.pairs[table][code[:, :span]]
        for i in range(1, w // 2):
            z += network.pairs[table + i][code[:, 2 * i : 2 * i + span]]
        table += w // 2
        pooled.append(z.max(axis=1))
    h = np.maximum(np.concatenate(pooled, axis=1) + network.bias, 0)
    logits = h @ network.out + network.out_bias
    q = np.exp(logits - logits.max(axis=1, keepdims=True))
    return q / q.sum(axis=1, keepdims=True)


def _cut(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and the text of each; the last window of a text is padded with zeros."""
    data, starts = flat(text)
    lengths = np.diff(starts)
    counts = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[:-1][owner] + number * WINDOW
    size = np.minimum(WINDOW, starts[1:][owner] - first)
    at = first[:, None] + np.arange(WINDOW)
    windows = np.where(np.arange(WINDOW) < size[:, None], LOWER[data[np.minimum(at, max(0, len(data) - 1))]] if len(data) else 0, 0)
    return windows.astype(np.uint8), owner


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[65:91] = True
_LETTER[0xC2:] = True


def classify(network: Network, text: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    windows, owner = _cut(text)
    total = np.zeros((len(text), len(network.languages)))
    for a in range(0, len(windows), 128):
        part = windows[a : a + 128]
        # An empty share of letters does not silence a window that is all the text has.
        weight = _LETTER[part].sum(axis=1) + 1e-6
        np.add.at(total, owner[a : a + 128], probabilities(network, part) * weight[:, None])
    has_letter = np.array([t is not None and any(map(str.isalpha, t)) for t in text.to_pylist()], bool)
    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
    best = total.argmax(axis=1) if len(network.languages) else np.zeros(len(text), int)
    names = [network.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)]
    return names, np.where(has_letter, total.max(axis=1, initial=0.0), 0.0).clip(0, 1)


_FOUND = [("lang_pred", pa.string()), ("lang_score", pa.float64())]


def _scorer(network: Network | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            if network is None:
                names, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                names, scores = classify(network, batch.column("text"))
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*[c for c in batch.schema.names if c != "text"], "lang_pred", "lang_score"],
            )

    return score


def _predictor(network: Network | None):
    score = _scorer(network)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            parts = list(score(iter([pa.RecordBatch.from_arrays([text], names=["text"])])))
            columns = [pa.concat_arrays([p.column(c) for p in parts]) if parts else pa.array([], t) for c, t in _FOUND]
            yield pa.StructArray.from_arrays(columns, names=[c for c, _ in _FOUND])

    return predict


def fold(doc_id: str = "doc_id") -> Column:
    """Remainder of the CRC-32 of the id as text; a null id has none."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def _sampled(usable: DataFrame, sample_per_language: int) -> DataFrame:
    """(id, l): of each language about ``sample_per_language`` ids, those with the smallest hashes; fewer if there are many languages.

    The share of ids to take follows from their approximate number per language, so nothing is sorted and no task holds a language.
    """
    filled = usable.where("text IS NOT NULL AND text <> ''")
    counts = filled.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n_ids"))
    languages = counts.count()
    each = max(1, min(sample_per_language, SAMPLE_ROWS // max(1, languages)))
    share = F.lit(float(each)) / F.col("n_ids")
    limit = F.when(share >= 1.0, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + share * F.lit(2.0**64)).cast("long"))
    limits = counts.select("lang", limit.alias("limit"))
    ids = filled.select("doc_id", "lang", F.xxhash64("doc_id").alias("o"))
    kept = ids.join(F.broadcast(limits) if languages <= SAMPLE_ROWS else limits, "lang").where("o <= limit")
    return kept.select(F.col("doc_id").alias("id"), F.col("lang").alias("l")).distinct()


def learn(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """A network from labelled rows (doc_id, text, lang) outside the held-out fold; None if there are none."""
    usable = docs.where("lang IS NOT NULL").where(F.coalesce(fold() != 2, F.lit(True)))
    chosen = _sampled(usable, sample_per_language)
    # About SAMPLE_ROWS ids at most, or one for each language; one stretch of each text, placed by hash, goes to the driver.
    stretch = F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id, 3), greatest(char_length(text) - {WINDOW}, 1)) as int), {WINDOW})")
    rows = usable.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l")))
    rows = rows.groupBy("doc_id", "lang").agg(F.min(stretch).alias("t")).where("t <> ''").orderBy("lang", "doc_id").collect()
    if not rows:
        return None
    return train([r.t for r in rows], [r.lang for r in rows])


def scored_rows(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", network: Network | None = None
) -> DataFrame:
    """(kept, lang_pred, lang_score): each row of ``docs`` as a struct, whatever its columns are called."""
    if network is None:
        network = learn(pick(docs, doc_id=id_column, text=text_column, lang=lang_column))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Only texts go to Python, and only languages come back. Marked as not deterministic, else a filter on the result would
    # be moved below and score every text once more.
    found = F.arrow_udf(_predictor(network), T.StructType.fromDDL("lang_pred string, lang_score double")).asNondeterministic()
    return docs.select(others.alias("kept"), found(F.col(f"`{text_column}`")).alias("found")).select("kept", "found.*")


def with_language(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", network: Network | None = None
) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``lang_score``, which must not be names of its columns. Labels serve for learning only."""
    return scored_rows(docs, id_column, text_column, lang_column, network).select("kept.*", "lang_pred", "lang_score")


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = pick(docs, doc_id="doc_id", text="text", lang="lang")
    network = learn(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(network), f"doc_id {id_type}, lang_pred string, lang_score double")
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
