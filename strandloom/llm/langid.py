"""Language identification with a string kernel.

Kernel: blended spectrum with presence. A text is the set of its 1- to 4-grams
of lower-cased characters (anything but letters is one blank), hashed to
``DIMENSIONS`` presence bits; k(x, z) = |x & z| / sqrt(|x| |z|). Nystroem: ``LANDMARKS`` training texts span the
approximate feature space K_xl W^-1/2, where one-versus-rest kernel ridge
regression is solved; both steps fold into one matrix, so a batch is scored by two
matrix products. Predicted is the language of the highest output; its score is
the softmax of the outputs, in 0..1.

Learned from a bounded sample (``SAMPLE`` rows at most, lowest hash of the id first) of rows
outside the held-out fold with a language and a letter in the text; of rows that repeat a doc_id, one. Texts of any length
are read whole; equal outputs go to the language that sorts first. Null texts
and texts without a letter: ``und`` with score 0. If nothing can be
learned from, every text is ``und``. Repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_ddl, held_out

DIMENSIONS, LANDMARKS, SAMPLE, RIDGE, ORDERS, SHARPNESS = 1 << 14, 160, 2000, 1e-2, (1, 2, 3, 4), 6.0
_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """The hashed n-grams present in the whole text."""
    codes = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), dtype=np.uint32)
    present, value = np.zeros(DIMENSIONS, dtype=bool), np.zeros(len(codes), dtype=np.uint32)
    for n in ORDERS:
        if len(codes) < n:
            break
        value = value[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]
        mixed = (value ^ np.uint32(n)) * np.uint32(0x9E3779B1)
        present[mixed >> np.uint32(32 - DIMENSIONS.bit_length() + 1)] = True
    return present


def presence(texts: list[str]) -> np.ndarray:
    """Rows of unit length."""
    x = np.array([grams(t) for t in texts], dtype=np.float32).reshape(-1, DIMENSIONS)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x dimensions
    weights: np.ndarray  # landmarks x languages

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        out = presence(texts) @ self.landmarks.T @ self.weights
        best = out.argmax(axis=1)
        e = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)))
        return [self.languages[i] for i in best], (e / e.sum(axis=1, keepdims=True))[np.arange(len(best)), best]


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """rows: text, language."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    x = presence([t for t, _ in rows])
    by = {lang: [i for i, r in enumerate(rows) if r[1] == lang] for lang in languages}
    chosen = sorted(i for lang in languages for i in by[lang][: max(1, landmarks // len(languages))])
    at = x[chosen]
    values, vectors = np.linalg.eigh((at @ at.T).astype(np.float64))
    keep = values > 1e-8 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = (x @ at.T).astype(np.float64) @ root
    y = np.array([[1.0 if lang == one else -1.0 for one in languages] for _, lang in rows])
    share = np.array([1 / len(by[lang]) for _, lang in rows]) * len(rows) / len(languages)  # languages weigh alike
    solved = np.linalg.solve(phi.T @ (phi * share[:, None]) + ridge * len(rows) / 100 * np.eye(phi.shape[1]), phi.T @ (y * share[:, None]))
    return Model(languages, at, (root @ solved).astype(np.float32))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The sample is chosen by ids alone; its texts are fetched by joining those few ids."""
    chosen = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one")).collect()
    return fit([(r.one.text, r.one.lang) for r in sorted(rows, key=lambda r: r.doc_id)])


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, out, texts = (c.to_pylist() for c in batch.slice(start, 256).columns)
                at = [i for i, t in enumerate(texts) if own and t and any(map(str.isalpha, t))]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if at:
                    for i, name, value in zip(at, *own.score([texts[i] for i in at]), strict=True):
                        lang[i], score[i] = name, float(value)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=OUT)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, arrow_ddl(OUT))
