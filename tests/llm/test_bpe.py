"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tidewatch.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", " \n\t ", "Hello, world!! It's 'the' end''s of we'll they've I'd I'm 'sad 'lla !'s 's's don't",
    "<|endoftext|>a<|startoftext|> b<|ENDOFTEXT|>", "ÉÈ é ΑΣ ΣΑΣ. Straße İstanbul ǅ ﬁ ½ ² x² 3.14 12345",
    "a\x1cb\x85c\xa0d​e　f﻿", "日本語のテキスト 🎉🎉 👩‍👩‍👧 \U0001f600abc", "aaaaaaaaaaaaaaaaaaaa aaaaa banananananana mississippi" * 3,
    "z" * 3000, "|||---===***&&&", "abc</w> </w>",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    syllables = ["the", "ing", "er", "an", "ou", "tion", "sch", "ß", "é", "que", "ll", "st", "a", "x", "'", "-", ".", "7", "ñ"]
    made = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 8))) for _ in range(200)) for _ in range(40)]
    made += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x3FF), rng.randint(0x400, 0xD7FF)])) for _ in range(300)) for _ in range(20)]
    return TEXTS + made


def test_ids_and_decoded_text(spark, texts):
    library = tokenizers.Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    rows = list(enumerate(texts)) + [(None, "null id"), (3, TEXTS[3])]
    wanted = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted.append((i, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), decoded))))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string").repartition(3)
    got = [tuple(r) for r in bpe.encoding_report(docs, PATH).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert bpe.encoding_report(docs.limit(0), PATH).count() == 0


def test_every_token_that_can_occur(texts):
    """Each token's own text is encoded as the library does, also where it is no token of its own."""
    library = tokenizers.Tokenizer.from_file(PATH)
    model = bpe.load(PATH)
    to_byte = bpe.byte_names()
    words = [bytes(to_byte[c] for c in name.removesuffix("</w>")) for name in model.names if name not in model.special]
    got = bpe.encode_words(model, words)
    for word, ids in list(zip(words, got, strict=True))[::7]:
        text = word.decode(errors="replace")
        if bpe.split_words(model, [text])[0].to_pylist() == [word]:
            assert library.encode(text, add_special_tokens=False).ids == ids.tolist(), text


def test_a_long_word_beside_many_short_ones(monkeypatch):
    """Tables of words stay within their bound, and the ids are those of words encoded alone."""
    model = bpe.load(PATH)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))).encode() for _ in range(3000)]
    words[1000] = "".join(rng.choices("etaoinshr", k=20_000)).encode()
    words[2000] = b"=" * 5000
    cells, inner = [], bpe._encode_block

    def counted(model, block, sizes):
        cells.append(len(block) * (max(map(len, block)) + 1))
        return inner(model, block, sizes)

    monkeypatch.setattr(bpe, "_encode_block", counted)
    got = bpe.encode_words(model, words)
    assert max(cells) <= 4_000_000
    for i in (0, 999, 1000, 2000, 2999):
        assert got[i].tolist() == bpe.encode_words(model, [words[i]])[0].tolist()
    to_byte = bpe.byte_names()
    joined = b"".join(b"".join(bytes(to_byte[c] for c in model.names[t].removesuffix("</w>")) for t in ids.tolist()) for ids in got)
    assert joined == b"".join(words)


def test_every_code_point():
    """Alone, after a letter, after a sign and doubled: classes, lower case and composition are those of the library."""
    library = tokenizers.Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    encoder = bpe.Encoder(bpe.load(PATH))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(f"a{c} !{c} {c}{c}" for c in map(chr, points[i : i + 4096])) for i in range(0, len(points), 4096)]
    _, ids, decoded = encoder.encode(pa.array(texts))
    for text, mine, read in zip(texts, ids.to_pylist(), decoded.to_pylist(), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert mine == " ".join(map(str, wanted)), hex(ord(text[1]))
        assert read == library.decode(wanted, skip_special_tokens=False)


def test_new_letters_beside_special_tokens():
    library = tokenizers.Tokenizer.from_file(PATH)
    encoder = bpe.Encoder(bpe.load(PATH))
    text = "\u1c89A<|endoftext|>\ua7cbe\u0301 \U00010d50x ΑΣ " * 3
    _, ids, _ = encoder.encode(pa.array([text, None, "plain"]))
    assert ids[0].as_py() == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
