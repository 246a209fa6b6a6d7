import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside.
CLASHING = ["hash", "body", "row", "order", "fp", "part", "size", "value", "key", "rank", "target", "component", "word", "c0"]


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text[, lang, source]) as a documents table."""

    def make(rows):
        full = [(*r, *["en", "s"][len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
        full = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1])) for r in full]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def clashing():
    """The same rows with further columns, named like the operators' own."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({name: F.lit(i) for i, name in enumerate(CLASHING) if name not in df.columns})

    return add


@pytest.fixture
def texts():
    """Some texts with copies, near copies and shared passages."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]

    def phrase(n):
        return [rng.choice(words) for _ in range(n)]

    passages = [phrase(60), phrase(75)]
    found = []
    for i in range(60):
        text = phrase(rng.randint(0, 120))
        if i % 5 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = passages[i % 2][rng.randint(0, 12) :]
        found.append(text)
    for i in range(8):
        near = list(found[i + 20])
        if len(near) > 60:
            near[30] = "changed"
        found.append(near)
    found += [found[3], found[3], found[11], []]
    return [" ".join(t) for t in found]
