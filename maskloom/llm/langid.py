"""Language identification by levels: first the family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import words as W
from maskloom.llm.linear import fit_scale, fit_svm, sigmoid
from maskloom.llm.lm import bucket_of
from maskloom.llm.store import prepare

#: Language families by ISO 639-1 code (fixed values). A code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "celtic": "ga gd cy br",
    "indic": "hi ur bn pa mr gu ne si",
    "iranian": "fa ku tg ps",
    "semitic": "ar he mt am",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Hashed byte n-grams: cells for n = 1, 2, 3.
SIZES = (256, 1024, 4096)
WIDTH = sum(SIZES)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _cells(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, cell of the n-gram at each byte); ASCII letters lower-cased, other ASCII as spaces."""
    byte = _FOLD[data].astype(np.uint32)
    gram, offset = byte, 0
    for n, size in enumerate(SIZES, 1):
        if n > 1:
            gram = (gram[:-1] << np.uint32(8)) | byte[n - 1 :] if len(gram) else gram
        shift = np.uint32(32 - (size.bit_length() - 1))
        yield n, offset + ((gram * np.uint32(2654435761)) >> shift).astype(np.int64)
        offset += size


def _frequencies(data: np.ndarray) -> np.ndarray:
    """Shares of the n-grams of one text, for each n."""
    out = np.zeros(WIDTH)
    for _, cell in _cells(data):
        if len(cell):
            np.add(out, np.bincount(cell, minlength=WIDTH) / len(cell), out=out)
    return out


@dataclass
class Model:
    """Linear functions of n-gram shares: families against the rest, then pairs within each family."""

    families: list[str]
    langs: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # one column a function: families, then pairs
    bias: np.ndarray
    slope: np.ndarray

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Value of every function for each text, over the whole text."""
        out = np.tile(self.bias, (len(at) - 1, 1))
        for n, cell in _cells(data):
            n_grams = np.maximum(np.diff(at) - n + 1, 0)
            first = np.minimum(at[:-1], len(cell))
            last = first + n_grams
            for k in range(self.weights.shape[1]):
                total = np.zeros(len(cell) + 1)
                np.cumsum(self.weights[cell, k], out=total[1:])
                out[:, k] += (total[last] - total[first]) / np.maximum(n_grams, 1)
        return out

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, chance)."""
        m = self.margins(data, at)
        p = sigmoid(m * self.slope)
        nf = len(self.families)
        if nf == 1:
            family, sure = np.zeros(len(m), int), np.ones(len(m))
        else:
            family, share = m[:, :nf].argmax(1), p[:, :nf] / p[:, :nf].sum(1, keepdims=True)
            sure = share[np.arange(len(m)), family]
        lang = np.empty(len(m), object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            langs = self.langs[name]
            votes, belief = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for j, (a, b) in enumerate(self.pairs):
                if a in langs:
                    for_a = p[rows, nf + j]
                    for side, chance in ((a, for_a), (b, 1 - for_a)):
                        votes[:, langs.index(side)] += chance > 0.5
                        belief[:, langs.index(side)] += chance
            best = (votes + belief / (belief.max() + 1 if belief.size else 1)).argmax(1)
            lang[rows] = np.array(langs, object)[best]
            if len(langs) > 1:
                sure[rows] *= belief[np.arange(len(rows)), best] / (len(langs) - 1)
        return lang, np.clip(sure, 0, 1)


def fit(x: np.ndarray, lang: np.ndarray) -> Model:
    family = np.array([FAMILY.get(v, v) for v in lang], object)
    families = sorted(set(family))
    langs = {f: sorted(set(lang[family == f])) for f in families}
    scale = (1 / np.maximum(x.std(0), 1e-4)).astype(np.float32)
    middle = x.mean(0)
    z = (x - middle) * (scale / np.float32(np.sqrt(WIDTH)))
    jobs = [(np.ones(len(x), bool), np.where(family == f, 1, -1)) for f in families]
    pairs = [p for f in families for p in combinations(langs[f], 2)]
    jobs += [((lang == a) | (lang == b), np.where(lang == a, 1, -1)) for a, b in pairs]
    weights, bias, slope = [], [], []
    for use, y in jobs:
        w, b = fit_svm(z[use], y[use]) if len(set(y[use])) > 1 else (np.zeros(x.shape[1]), 1.0)
        slope.append(fit_scale(z[use] @ w + b, y[use]))
        w = w * scale / np.sqrt(WIDTH)
        weights.append(w)
        bias.append(b - middle @ w)
    return Model(families, langs, pairs, np.array(weights).T.copy(), np.array(bias), np.array(slope))


def identify(
    docs: DataFrame,
    held_out_mod: int = 4,
    held_out_rest: int = 2,
    rows_per_lang: int = 400,
    most_rows: int = 6000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Language of every whole text, learnt from the rows of ``docs`` whose bucket is not held out.

    Inputs are shares of hashed byte 1- to 3-grams of the text alone. A one-versus-rest linear SVM
    picks the family, one-versus-one linear SVMs vote among the languages of that family. They are
    fitted on the driver on a bounded sample of labelled rows (whole texts): every language that the
    training rows have gets the same number of rows, about ``rows_per_lang`` or its share of
    ``most_rows`` if there are many languages, those whose id hash is under the language's threshold.
    No task holds a language together, and no language is left out. Prediction is one scan.

    Null texts and texts without a letter get ``und`` and score 0, as does every text if there are no
    training rows. Rows with null language, text or id do not train; of rows that repeat an id one
    trains. Null ids are kept; repeated rows are scored alike; very long texts count whole; other
    columns are ignored; an empty table gives an empty result.

    Returns id, held_out, lang_pred, score (0 to 1).
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out = bucket_of(F.col("id"), held_out_mod) == held_out_rest
    train = rows.where(~out & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") > 0))
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language, as the model has
    quota = max(1, min(rows_per_lang, most_rows // max(1, len(counts))))
    shares = spark.createDataFrame([(lang, min(1.0, quota / n)) for lang, n in counts.items()], "lang string, share double")
    chance = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / float(1 << 53)
    picks = train.join(F.broadcast(shares), "lang").where(chance < F.col("share")).select("id", "lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.text_bytes(batch.column("text"))
            vectors = [_frequencies(data[a:b]).astype(np.float32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([batch.column("id"), batch.column("lang"), pa.array(vectors, pa.binary())], ["id", "lang", "x"])

    held = out.alias("held_out")
    sample = picks.mapInArrow(features, "id long, lang string, x binary").groupBy("id").agg(F.min(F.struct("lang", "x")).alias("s")).select("id", "s.*").toArrow() if counts else None
    if sample is None or not sample.num_rows:
        return rows.select(F.col("id").alias(id_col), held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sample = sample.sort_by("id")
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.float32).reshape(sample.num_rows, WIDTH)
    model = spark.sparkContext.broadcast(fit(x, np.array(sample["lang"].to_pylist(), object)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in W.pieces(batch):
                lang, score = model.value.predict(data, at)
                letters = np.concatenate([[0], np.cumsum(_FOLD[data] != 0x20)])
                lettered = letters[at[1:]] > letters[at[:-1]]  # a byte beyond ASCII may be a letter or not
                ascii_letters = np.concatenate([[0], np.cumsum((_FOLD[data] != 0x20) & (data < 128))])
                for k in np.flatnonzero(lettered & (ascii_letters[at[1:]] == ascii_letters[at[:-1]])).tolist():
                    lettered[k] = any(map(str.isalpha, data[at[k] : at[k + 1]].tobytes().decode()))
                lang[~lettered], score[~lettered] = "und", 0.0
                yield pa.record_batch([part.column("id"), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    done = rows.select("id", "text").mapInArrow(predict, "id long, lang_pred string, score double")
    return done.select(F.col("id").alias(id_col), held, "lang_pred", "score")
