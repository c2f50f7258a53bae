"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can be the last one of its encoding. The candidates are the vocabulary's tokens
that are suffixes of the prefix; an automaton over the vocabulary follows the word and links each state to these suffixes, longest
first. A candidate is the one if it may stand after the unique last token of the prefix before it: undoing the
merges of both tokens, latest first, no merge across their border would have come earlier. Back-pointers from the end of the word then give the exact ids.
Words go through this in step, as numpy arrays, each different word of a batch once.

The vocabulary file (a parameter) describes a tokenizer whose words end in ``</w>``: NFC, lower case, white space dropped, split into
contractions, runs of letters, single digits and runs of the rest. Decoding lists the tokens, as the file names no decoder.

Defined results: a null or empty text has no tokens and decodes to an empty text. Rows are encoded one by one, so repeated rows and null
ids are no case of their own. The strings of special tokens in a text are special tokens. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidewatch.llm.tables import pick
from tidewatch.llm.textops import chunks

END = 256
NONE = -1
NEVER = np.int64(1 << 40)
#: Words remembered by a task; beyond that the memory starts anew. It saves work only.
REMEMBERED = 200_000

# Unicode White_Space, which the tokenizer's \s stands for, and the contractions it splits off.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

SPACE, LETTER, DIGIT, REST, SPECIAL = range(5)


@dataclass
class Model:
    """Arrays of a vocabulary. Ids of merged tokens are in the order of their merges."""

    names: list[str]
    special: dict[str, int]
    size: np.ndarray  # bytes of each token
    rank: np.ndarray  # of the merge that makes it; -1 for single bytes
    left: np.ndarray
    right: np.ndarray
    pair_key: np.ndarray  # sorted, left * n + right
    pair_rank: np.ndarray
    edge_key: np.ndarray  # sorted, state * 257 + symbol
    edge_to: np.ndarray
    fail: np.ndarray
    longest: np.ndarray  # longest token that ends in a state
    shorter: np.ndarray  # the next shorter token that is a suffix of a token
    classes: np.ndarray
    unknown: np.ndarray  # code points that Python's tables do not know


def byte_names() -> dict[str, int]:
    """Characters that stand for bytes: printable Latin-1 for itself, the rest from U+0100 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point, and which code points are unknown to Python's tables.

    The tokenizers library may follow a later Unicode version than Python, so it is asked about those: a letter joins a
    letter before it, a sign joins a sign, a digit neither.
    """
    from tokenizers import Regex, pre_tokenizers

    kinds = {"L": LETTER, "N": DIGIT}
    category = [unicodedata.category(chr(c)) for c in range(0x110000)]
    classes = np.array([kinds.get(k[0], REST) for k in category], np.uint8)
    unknown = np.array([k == "Cn" for k in category])
    runs = pre_tokenizers.Split(Regex(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"), behavior="removed", invert=True)

    def joined(sign: str, points: np.ndarray) -> np.ndarray:
        """Which code points stand in one piece with ``sign`` before them."""
        pieces = runs.pre_tokenize_str("\n".join(sign + chr(c) for c in points.tolist()))
        # Each line has three characters with its end.
        both = np.zeros(len(points), bool)
        for _, (start, end) in pieces:
            both[start // 3] |= end - start == 2
        return both

    points = np.flatnonzero(unknown)
    letters = joined("a", points)
    signs = joined("!", points[~letters])
    classes[points[letters]] = LETTER
    classes[points[~letters][~signs]] = DIGIT
    classes[WHITE_SPACE] = SPACE
    return classes, unknown


def load(path: str) -> Model:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    n = max([*vocabulary.values(), *special.values()]) + 1
    names = [""] * n
    for name, i in [*vocabulary.items(), *special.items()]:
        names[i] = name
    suffix, to_byte = spec["model"]["end_of_word_suffix"], byte_names()
    symbols: dict[int, list[int]] = {}
    for name, i in vocabulary.items():
        ended = name.endswith(suffix)
        symbols[i] = [to_byte[c] for c in (name.removesuffix(suffix) if ended else name)] + [END] * ended
    size = np.zeros(n, np.int64)
    for i, s in symbols.items():
        size[i] = len(s) - (s[-1] == END)
    rank, left, right = np.full(n, -1, np.int64), np.full(n, NONE, np.int64), np.full(n, NONE, np.int64)
    pairs = []
    for r, merge in enumerate(spec["model"]["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        i = vocabulary[a + b]
        rank[i], left[i], right[i] = r, vocabulary[a], vocabulary[b]
        pairs.append((vocabulary[a] * n + vocabulary[b], r))
    pairs.sort()
    model = Model(
        names, special, size, rank, left, right, np.array([k for k, _ in pairs]), np.array([r for _, r in pairs]),
        *(np.zeros(0, np.int64) for _ in range(5)), *character_classes(),
    )
    # A token that its own text is not encoded to never occurs; every other one is the merge of two that fit.
    merged = np.flatnonzero(rank >= 0)
    usable = np.ones(n, bool)
    for i in merged[np.argsort(rank[merged], kind="stable")]:
        usable[i] = usable[left[i]] and usable[right[i]]
    usable[merged] &= compatible(model, left[merged], right[merged], rank[merged])
    _automaton(model, {i: s for i, s in symbols.items() if usable[i]}, n)
    return model


def _automaton(model: Model, symbols: dict[int, list[int]], n: int) -> None:
    children: list[dict[int, int]] = [{}]
    token, state_of = [NONE], {}
    for i, s in symbols.items():
        state = 0
        for c in s:
            if c not in children[state]:
                children[state][c] = len(children)
                children.append({})
                token.append(NONE)
            state = children[state][c]
        token[state], state_of[i] = i, state
    fail, longest = np.zeros(len(children), np.int64), np.array(token, np.int64)
    queue = list(children[0].values())
    for state in queue:
        if longest[state] == NONE:
            longest[state] = longest[fail[state]]
        for c, to in children[state].items():
            back = fail[state]
            while back and c not in children[back]:
                back = fail[back]
            fail[to] = children[back].get(c, 0)
            queue.append(to)
    edges = sorted((s * 257 + c, to) for s, kids in enumerate(children) for c, to in kids.items())
    model.edge_key, model.edge_to = np.array([k for k, _ in edges]), np.array([to for _, to in edges])
    model.fail, model.longest = fail, longest
    model.shorter = np.full(n, NONE, np.int64)
    for i, state in state_of.items():
        model.shorter[i] = longest[fail[state]]


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def compatible(model: Model, a: np.ndarray, b: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
    """Whether token b may follow token a: no merge across the border comes before the merges that made a and b.

    ``bound`` is the rank before which a merge of the two whole tokens counts; by default any does.
    """
    n = len(model.names)
    good = np.ones(len(a), bool)
    at, a, b = np.arange(len(a)), a.copy(), b.copy()
    bound = np.full(len(a), NEVER) if bound is None else bound.copy()
    while len(at):
        across = _found(model.pair_key, model.pair_rank, a * n + b, NEVER)
        good[at[across < bound]] = False
        ra, rb = model.rank[a], model.rank[b]
        go_on = (across >= bound) & ((ra >= 0) | (rb >= 0))
        at, a, b, ra, rb = at[go_on], a[go_on], b[go_on], ra[go_on], rb[go_on]
        # The later of the two merges is undone first; of the same merge, the one on the right. On a tie of ranks the
        # merge further left goes first.
        undo_a = ra > rb
        bound = np.where(undo_a, ra, rb + 1)
        a, b = np.where(undo_a, model.right[a], a), np.where(undo_a, b, model.left[b])
    return good


#: Cells of the table of a block of words, of 8 bytes; a longer word is a block of its own.
CELLS = 4_000_000


def encode_words(model: Model, words: list[bytes]) -> list[np.ndarray]:
    """Ids of each word."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    # Words of similar length go together, so padding stays small; a table of few long words is as large as one of many short ones.
    a = 0
    while a < len(order):
        widths = sizes[order[a : a + 16384]] + 1
        fit = int(np.searchsorted(np.arange(1, len(widths) + 1) * widths, CELLS, side="right"))
        part = order[a : a + max(1, fit)]
        a += len(part)
        for i, ids in zip(part, _encode_block(model, [words[i] for i in part], sizes[part]), strict=True):
            out[i] = ids
    return out


def _encode_block(model: Model, words: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    width = int(sizes.max())
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(words), np.uint8)
    known: dict[int, bool] = {}
    n = len(model.names)
    last = np.full((len(words), width + 1), NONE, np.int64)
    state = np.zeros(len(words), np.int64)

    def step(rows: np.ndarray, symbol: np.ndarray) -> None:
        here = state[rows]
        todo = np.arange(len(rows))
        while len(todo):
            to = _found(model.edge_key, model.edge_to, here[todo] * 257 + symbol[todo], NONE)
            done = (to != NONE) | (here[todo] == 0)
            state[rows[todo[done]]] = np.maximum(to[done], 0)
            todo = todo[~done]
            here[todo] = model.fail[here[todo]]

    def choose(rows: np.ndarray, end: np.ndarray) -> None:
        candidate = model.longest[state[rows]]
        while len(rows):
            start = end - model.size[candidate]
            before = last[rows, start]
            fits = start == 0
            ask = np.flatnonzero(~fits)
            key = before[ask] * n + candidate[ask]
            distinct, back = np.unique(key, return_inverse=True)
            keys = distinct.tolist()
            fresh = np.array([k for k in keys if k not in known], np.int64)
            if len(fresh):
                known.update(zip(fresh.tolist(), compatible(model, fresh // n, fresh % n).tolist(), strict=True))
            answer = np.fromiter(map(known.__getitem__, keys), bool, len(keys))
            fits[ask] = answer[back]
            last[rows[fits], end[fits]] = candidate[fits]
            rows, end, candidate = rows[~fits], end[~fits], model.shorter[candidate[~fits]]

    for i in range(1, width + 1):
        rows = np.flatnonzero(sizes >= i)
        step(rows, data[starts[rows] + i - 1].astype(np.int64))
        inner = rows[sizes[rows] > i]
        choose(inner, np.full(len(inner), i))
        final = rows[sizes[rows] == i]
        step(final, np.full(len(final), END))
        choose(final, np.full(len(final), i))
    # Back-pointers, all words in step.
    at, steps = sizes.copy(), []
    while (at > 0).any():
        token = np.where(at > 0, last[np.arange(len(words)), at], NONE)
        steps.append(token)
        at = np.where(at > 0, at - model.size[token], 0)
    ids = np.stack(steps[::-1], axis=1)
    return [row[row != NONE] for row in ids]


def _normal(text: str, special: list[str]) -> str:
    text = _marked(text, special)
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _marked(text: str, special: list[str]) -> str:
    for i, name in enumerate(special):
        # Lone surrogates cannot be in a text; one stands for each special token.
        if name in text:
            text = text.replace(name, chr(0xD800 + i))
    return text


def _normal_by_library(text: str, special: list[str]) -> str:
    """The same for a text with characters that are newer than Python's tables."""
    from tokenizers import normalizers

    rule = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    parts = re.split("([\ud800-\udfff])", _marked(text, special))
    return "".join(part if i % 2 else rule.normalize_str(part) for i, part in enumerate(parts))


def _all_normal(model: Model, texts: list[str | None]) -> list[str]:
    special = list(model.special)
    normal = [_normal(t or "", special) for t in texts]
    # Lower case and composition leave such characters in place, so the normal text shows them.
    for i, t in enumerate(normal):
        if not t.isascii() and model.unknown[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            normal[i] = _normal_by_library(texts[i], special)
    return normal


def split_words(model: Model, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts as bytes, and the n + 1 places where the texts start."""
    normal = _all_normal(model, texts)
    joined = "\n".join([*normal, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    kind = model.classes[code].copy()
    kind[(code >= 0xD800) & (code < 0xD800 + len(model.special))] = SPECIAL
    start = np.empty(len(code), bool)
    start[0] = True
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (kind[1:] == SPECIAL)
    quote = np.flatnonzero((code == 0x27) & start)
    # A run of one quote before a letter may be a contraction.
    quote = quote[(quote + 1 < len(code)) & (kind[np.minimum(quote + 1, len(code) - 1)] == LETTER)]
    padded = np.r_[code, 0, 0, 0]
    open_ = np.ones(len(quote), bool)
    for tail in CONTRACTIONS:
        same = open_.copy()
        for k, c in enumerate(tail):
            same &= padded[quote + 1 + k] == ord(c)
        hit = quote[same]
        start[hit + 1] = False
        rest = hit + 1 + len(tail)
        start[rest[rest < len(code)]] = True
        open_ &= ~same
    start &= kind != SPACE
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    width_in = np.where(kind != SPACE, width, 0)
    byte_at = np.cumsum(width_in) - width_in
    first = np.flatnonzero(start)
    offsets = np.r_[byte_at[first], int(width_in.sum())].astype(np.int64)
    kept = np.ascontiguousarray(data[np.repeat(kind != SPACE, width)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    ends = np.cumsum([len(t) + 1 for t in normal])
    return words, np.r_[0, np.searchsorted(first, ends)] if len(normal) else np.zeros(1, np.int64)


class Encoder:
    """Encodes batches; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.ids = [str(i) for i in range(len(model.names))]
        self.memory: dict[bytes, tuple[int, str, str]] = {}
        self.fixed = {chr(0xD800 + i).encode("utf-8", "surrogatepass"): (1, str(t), name) for i, (name, t) in enumerate(model.special.items())}

    def _remember(self, words: list[bytes]) -> list[tuple[int, str, str]]:
        if len(self.memory) > REMEMBERED or not self.memory:
            self.memory = dict(self.fixed)
        new = [w for w in words if w not in self.memory]
        for w, ids in zip(new, encode_words(self.model, new) if new else [], strict=True):
            ids = ids.tolist()
            self.memory[w] = (len(ids), " ".join([self.ids[i] for i in ids]), " ".join([self.model.names[i] for i in ids]))
        return [self.memory[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of tokens, ids joined by spaces and decoded text of each text."""
        words, bounds = split_words(self.model, texts.to_pylist())
        coded = words.dictionary_encode()
        known = self._remember(coded.dictionary.to_pylist())
        codes = coded.indices
        counts = np.array([k[0] for k in known], np.int64)[codes.to_numpy()] if len(known) else np.zeros(0, np.int64)
        total = np.r_[0, np.cumsum(counts)]
        joined = []
        for part in (1, 2):
            values = pa.array([k[part] for k in known], pa.large_string()).take(codes)
            lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), values)
            joined.append(pc.binary_join(lists, pa.scalar(" ", pa.large_string())))
        return total[bounds[1:]] - total[bounds[:-1]], *joined


def _encoder(shared):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in chunks(batches, "text"):
            counts, ids, decoded = encoder.encode(batch.column("text"))
            digests = [pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in column], pa.string()) for column in (ids, decoded)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return encode


def encoding_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. The vocabulary is broadcast (a few MB, whatever the input)."""
    docs = pick(docs, doc_id="doc_id", text="text")
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(_encoder(shared), schema)
