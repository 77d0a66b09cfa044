"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training is scored by its log frequency in each language. An
unseen word is covered from left to right by the longest known character
n-grams (five letters down to one, word edges marked), each scored by its log
frequency among the n-grams of its length. All languages go the same way
through a word, so the sums compare. The language with the largest sum wins;
the score is its share when the mean evidence of a word is taken ``EVIDENCE``
times.

Learned from the bounded sample of :mod:`repeatlake.llm.labelled`, at most
``EACH`` documents of each language, chosen by a hash of their ids; every text
is scored whole.

Cases: null text and text without letters are ``und`` with score 0. Ties go to
the language that sorts first. A null ``doc_id`` is scored and not held out.
Without any learnable row all texts are ``und``. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlake.llm.arrow import map_rows, plain_text, texts
from repeatlake.llm.bpe import Memo
from repeatlake.llm.labelled import held_out, labelled_texts

EACH = 1500  # documents sampled of each language
LONGEST_GRAM = 5
EVIDENCE = 8.0
LEAST = 0.5  # under it no language has most of the evidence
UNKNOWN = "und"


def _ranges(kinds: str, first: int, last: int) -> str:
    """A character class of the code points from ``first`` to ``last`` whose Unicode category begins with one of ``kinds``."""
    out, start = [], None
    for point in range(first, last + 2):
        inside = point <= last and unicodedata.category(chr(point))[0] in kinds
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(point - 1))}")
            start = None
    return f"[{''.join(out)}]"


def _words() -> re.Pattern:
    """Words begin with a letter (not with what merely counts as a word character, such as a superscript) and hold letters and marks.

    Classes within the first 65,536 code points are looked up, others are gone
    through range by range, so these are tried only where such a code point is.
    """
    low, high, is_high = (0, 0xFFFF), (0x10000, sys.maxunicode), "(?=[\U00010000-\U0010ffff])"
    letter, more = ((_ranges(k, *low), is_high + _ranges(k, *high)) for k in ("L", "LM"))
    return re.compile(f"(?:{letter[0]}|{letter[1]})(?:{more[0]}++|{more[1]})*+")


WORD = _words()


class Model:
    """Log frequencies of words and n-grams by language; bounded by the sample and shipped to every task."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({y for _, y in rows})
        words = {y: Counter() for y in self.langs}
        for text, y in rows:
            words[y].update(WORD.findall(text.lower()))
        grams = [{y: Counter() for y in self.langs} for _ in range(LONGEST_GRAM + 1)]
        for y, seen in words.items():
            for word, n in seen.items():
                marked = f" {word} "
                for size in range(1, LONGEST_GRAM + 1):
                    into = grams[size][y]
                    for k in range(len(marked) - size + 1):
                        into[marked[k : k + size]] += n
        self.words = self._logs(words, 2)
        self.grams = [self._logs(g, 3) if k else {} for k, g in enumerate(grams)]

    def _logs(self, counts: dict[str, Counter], least: int) -> dict[str, tuple]:
        kept = {w for c in counts.values() for w, n in c.items() if n >= least}  # rarer ones say too little
        total = {y: sum(c.values()) + 0.5 * len(kept) + 1 for y, c in counts.items()}
        return {w: tuple(math.log((counts[y][w] + 0.5) / total[y]) for y in self.langs) for w in kept}

    def word(self, word: str) -> tuple:
        """Evidence of one word, lower-cased, for each language."""
        known = self.words.get(word)
        if known:
            return known
        marked, k, grams = f" {word} ", 0, self.grams
        total = [0.0] * len(self.langs)
        while k < len(marked):
            for size in range(min(LONGEST_GRAM, len(marked) - k), 0, -1):
                got = grams[size].get(marked[k : k + size])
                if got:
                    total = [a + b for a, b in zip(total, got)]
                    k += size
                    break
            else:
                k += 1
        return tuple(total)

    def predict(self, text: str, memo) -> tuple[str, float]:
        seen = Counter(WORD.findall(text.lower()))
        if not seen or not self.langs:
            return UNKNOWN, 0.0
        evidence = np.array([memo[w] for w in seen])
        many = np.fromiter(seen.values(), np.float64, len(seen))
        mean = many @ evidence / many.sum()
        share = np.exp((mean - mean.max()) * EVIDENCE)
        best = int(mean.argmax())
        return self.langs[best], float(share[best] / share.sum())


def fit(documents: DataFrame, each: int = EACH) -> Model:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    return Model(labelled_texts(plain_text(documents), docs, "lang", each))


def predictions(documents: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every text."""

    def make():
        memo = Memo(model.word)

        def each(batch):
            got = [model.predict(t, memo) for t in texts(batch)]
            yield {"doc_id": batch.column(0), "lang_pred": [a for a, _ in got], "score": [b for _, b in got]}

        return each

    return map_rows(plain_text(documents, id_column), "doc_id long, lang_pred string, score double", make)


def with_language(documents: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of ``documents`` whose text is in a learned language with a score of at least ``least``, with all their columns."""
    memo: list[Memo] = []

    @F.pandas_udf("boolean")
    def told(text: pd.Series) -> pd.Series:
        if not memo:
            memo.append(Memo(model.word))
        got = (model.predict(t, memo[0]) for t in text)
        return pd.Series([lang != UNKNOWN and score >= least for lang, score in got], dtype="bool")

    return documents.where(told(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def query(spark, sf_dir: str) -> DataFrame:
    """``op3``: every document's language."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predictions(documents, fit(documents))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
