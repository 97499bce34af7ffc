import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture
def make_docs(spark):
    def make(texts, extra=False):
        """texts: list of text or (doc_id, text). With extra, columns whose names clash with operators' own."""
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("id", "key", "digest", "rest", "at", "w", "n", "label", "component_id", "score", "kept", "grams", "first_id"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture
def corpus():
    """Texts with copies, near copies, shared passages, short, empty and null ones, and odd white space."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(60, 200)) for _ in range(12)]
    passage = words(rng, 70)
    texts = [" ".join(b) for b in base]
    texts += [texts[0], texts[1], texts[0]]
    for b in base[:6]:
        near = list(b)
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
        texts.append(" ".join(b[:30] + passage + b[30:]))
    texts += ["", None, "   ", "one", "One", "a b c", "a  b\tc", "x " * 120, "X\n" * 120, "é ß 日本   z" * 30, " ".join(passage), texts[3].upper()]
    return texts
