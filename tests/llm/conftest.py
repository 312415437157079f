"""Small corpora with every awkward kind of row."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id_key string, text_key string, "
    "minimiser string, node string, gram string, shard string, salt string, rank string, length string, kept string"
)


def prose(rng: random.Random, n: int) -> str:
    parts = ["an", "ber", "co", "der", "é", "fin", "ge", "hu", "ing", "jo", "ü", "la", "mo", "ne", "or", "ß"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", "."]) for w in words)


def changed(rng: random.Random, text: str, share: float) -> str:
    return " ".join("X" + w if rng.random() < share else w for w in text.split(" "))


def corpus(seed: int = 3) -> list[tuple]:
    """Ids with texts: copies, near copies, shared passages, empty, blank, NULL and long ones."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(1, 260)) for _ in range(40)]
    passage, line = prose(rng, 90), prose(rng, 14)
    texts += [prose(rng, 60) + " " + passage + "\n" + prose(rng, rng.randint(0, 60)) for _ in range(6)]
    texts += ["\n".join([line, prose(rng, 40), line, line]) for _ in range(6)]
    base = prose(rng, 150)
    texts += [changed(rng, base, 0.02 * i) for i in range(8)] + [base, base, base.upper()]
    texts += [None, None, "", "", " \t\n ", "!?… 123", "a", "A b", "b A", "日本語 テキスト 한국어", "x́ İstanbul ΟΔΟΣ"]
    texts += [prose(rng, 6000) + passage, " ".join(["rep eat"] * 300)]
    rows = [(i, text) for i, text in enumerate(texts)]
    rows += [rows[3], rows[45], (None, texts[5]), (None, "no id at all"), (7, prose(rng, 120))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    langs = ["en", "de", None]
    full = [
        (i, text, langs[n % 3], "src0", None if text is None else len(text), *["clash"] * 10)
        for n, (i, text) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def plain(rows):
    """Rows of distinct ids only, as brute force expects them."""
    seen = {}
    for doc_id, text in rows[: len(rows) - 5]:
        seen[doc_id] = text
    return seen


@pytest.fixture(scope="session")
def plain_docs(spark, plain):
    return frame(spark, list(plain.items())).cache()
