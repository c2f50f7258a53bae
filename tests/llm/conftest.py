import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, row string, lines string"


@pytest.fixture(scope="session", autouse=True)
def _folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (doc_id, text) or (doc_id, text, source), with columns whose names clash with inner ones."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, line ends of all kinds."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = ["All rights reserved", "  cookie NOTICE\t", "Read more\r"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "lost text of five words"), (None, "lost text of five words"), (4, "One"), (5, "oNE")]
    for i in range(10, 60):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
        if i % 7 == 0:
            lines += [shared[0], shared[0].upper()]
        rows.append((i, "\n".join(lines)))
    rows += [(60, rows[20][1]), (61, rows[20][1].upper()), (11, rows[8][1]), (11, "another text of number eleven\nRead more")]
    rows.append((70, "\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(4000)) + "\nread more"))
    rows.append((71, "É\x1cñ Éa\x85b ßß\n" * 3))
    # Near copies: a base text and versions with a few words replaced.
    base = rng.choices(vocabulary, k=260)
    for i in range(100, 130):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    short = rng.choices(vocabulary, k=24)
    for i in range(130, 140):
        rows.append((i, " ".join(short[: 14 + i - 130])))
    return rows
