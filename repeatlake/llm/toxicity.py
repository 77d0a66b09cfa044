"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the text of ordinary documents and
a small one on that of toxic ones, each as zstd makes it. A text is cut into
windows of ``WIDE`` words that overlap. Each window is compressed twice: with the ordinary
dictionary, and with the toxic one put before it, so that what the second saves
is what only toxic text says this way; in the first, zeros fill the toxic one's
place, so that the ordinary content is as far from the window. Most toxic
documents are ordinary prose too, which is why the ordinary dictionary has to be large:
it holds what prose repeats, so that prose in the toxic dictionary saves little.

How many bytes windows save, in steps of ``CUTS``, and the most that one saves are a document's
features. A logistic curve, fitted to training documents that no dictionary has
seen, calibrates them to a score. Windows are remembered in a bounded memo.

Learned from the bounded sample of :mod:`repeatlake.llm.labelled`; every text is
scored whole.

Cases: null, empty and very short texts get the score of a document whose windows
save nothing. A null ``doc_id`` is scored and not held out. Repeated rows are
repeated. Without labels of both kinds all scores are 0. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlake.llm.arrow import map_rows, plain_text, texts
from repeatlake.llm.bpe import Memo
from repeatlake.llm.labelled import held_out, labelled_texts

EACH = 8000  # documents sampled of each label
CHECKED = 800  # of them, the most that the curve is fitted to; the others train the dictionaries
THRESHOLD = 0.3
ORDINARY_BYTES, TOXIC_BYTES = 4_000_000, 64_000  # of the trained dictionaries, at most
LEVEL = 9  # of matches that compression looks for
WIDE, STEP = 20, 17  # words of a window, and from one to the next
CONTEXT = 4  # words of a training window
CUTS = (1, 2, 3, 4, 5, 6, 8)  # bytes saved
WEIGHT = 4.0  # of an ordinary document in the curve
REPEATS = b"\1\0\0\0\4\0\0\0\x08\0\0\0"  # ends the header of a trained dictionary


def windows(text: str, wide: int, step: int) -> list[str]:
    words = text.lower().split()
    return [" ".join(words[k : k + wide]) + " " for k in range(0, max(1, len(words) - wide + step), step)] if words else []


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def trained(samples: list[str], size: int, segment: int) -> bytes:
    """What a dictionary trained on ``samples`` holds; of too little text for training all of it."""
    raw = [_encoded(s) for s in samples]
    try:
        made = zstandard.train_dictionary(size, raw, k=segment, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(raw)[-size:]
    return made[made.find(REPEATS) + len(REPEATS) :]


class Detector:
    """What training found: both dictionaries and the curve. Shipped to every task once."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, [0.0] * (len(CUTS) + 3)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _ready(self) -> None:
        made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (bytes(len(self.toxic)) + self.ordinary, self.toxic + self.ordinary)]
        for d in made:
            d.precompute_compress(level=LEVEL)
        self._pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False).compress for d in made]
        self._memo = Memo(self._saved)

    def _saved(self, window: str) -> int:
        """Bytes by which the toxic dictionary shortens a window."""
        raw, (plain, toxic) = _encoded(window), self._pair
        return len(plain(raw)) - len(toxic(raw))

    def features(self, text: str) -> np.ndarray:
        if not hasattr(self, "_pair"):
            self._ready()
        saved = np.array([self._memo[w] for w in windows(text, WIDE, STEP)] or [0], float)
        many = [(saved >= c).sum() for c in CUTS]
        return np.array([max(0.0, saved.max()), *(math.log1p(n) for n in many), many[1] / len(saved)])

    def score(self, text: str) -> float:
        z = self.weights[0] + float(self.features(text) @ np.array(self.weights[1:]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _curve(x: np.ndarray, y: np.ndarray, weight: float) -> list[float]:
    """Weights of a logistic curve by Newton steps with a small ridge, rows of class 0 counted ``weight`` times; the first is the constant."""
    x, each = np.hstack([np.ones((len(x), 1)), x]), np.where(y == 1, 1.0, weight)
    w, ridge = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, 0.5)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (each * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w -= np.clip(np.linalg.solve(hess, x.T @ (each * (p - y)) + ridge * w), -4, 4)
    return w.tolist()


def train(rows: list[tuple[str, int]]) -> Detector | None:
    """Dictionaries from the text of either label, the curve from up to ``CHECKED`` other rows of each, or from a third of them if there are few."""
    of = {k: [t for t, y in rows if int(y) == k] for k in (0, 1)}
    if not of[0] or not of[1]:
        return None
    check = {k: v[: min(CHECKED, len(v) // 3)] or v for k, v in of.items()}
    # different windows: copies of a document count once
    parts = {k: list(dict.fromkeys(w for t in (v[len(check[k]) :] or v) for w in windows(t, CONTEXT, CONTEXT))) for k, v in of.items()}
    model = Detector(trained(parts[0], ORDINARY_BYTES, 64), trained(parts[1], TOXIC_BYTES, 64))
    both = [(t, k) for k in (0, 1) for t in check[k]]
    weight = WEIGHT * len(check[1]) / len(check[0])
    model.weights = _curve(np.array([model.features(t) for t, _ in both]), np.array([k for _, k in both]), weight)
    return model


def fit(documents: DataFrame, labels: DataFrame, each: int = EACH) -> Detector | None:
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    return train(labelled_texts(plain_text(documents), marked, "toxic", each))


def without_toxic(documents: DataFrame, model: Detector | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that score under ``threshold``, with all their columns."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) if model else 0.0 for t in text], dtype="float64")

    return documents.where(score(F.coalesce(F.col("text").cast("string"), F.lit(""))) < threshold)


def query(spark, sf_dir: str) -> DataFrame:
    """``op8``: every document's toxicity."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(documents, labels)

    def make():
        return lambda batch: [{"doc_id": batch.column(0), "score": [model.score(t) if model else 0.0 for t in texts(batch)]}]

    out = map_rows(plain_text(documents), "doc_id long, score double", make)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
