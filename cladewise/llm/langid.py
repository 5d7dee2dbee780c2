"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of
a word is the sum, over all ways to cut it into pieces, of the product of their probabilities; the
forward recursion gives it in one pass. A text's score is the sum of its words' log-probabilities.
The piece probabilities come from expectation-maximisation over labelled words (the same recursion,
forwards and backwards), one language per group.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import guarded, map_arrow, share_of, ship
from .token_counts import vocabulary_path

#: Bound on the distinct labelled texts that one language's probabilities are fitted on.
FIT_ROWS = 400
#: Letters (with the word start) of a word that are fitted as one; longer words are fitted in spans of that size.
FIT_SPAN = 49
ROUNDS = 3
#: Added to every piece's expected count; the share of a character that is no piece.
SMOOTH, UNKNOWN = 0.05, 1e-7
#: Keeps products near 1: the usual loss of one character, in nats.
PER_CHAR = 3.0
CACHE_WORDS = 600_000

WORD = re.compile(r"[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces (lower-cased, a word start as U+2581) and a hash table from substring to piece number."""

    def __init__(self, name: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        pieces = sorted({p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)) and WORD.fullmatch((p := model.id_to_piece(i).lower()).replace("▁", "") or "a")})
        self.pieces = [p for p in pieces if "▁" not in p[1:]]
        self.longest = max(map(len, self.pieces))
        codes = [self._hash(p) for p in self.pieces]
        order = np.argsort(np.array(codes, dtype=np.uint64))
        self.hashes, self.numbers = np.array(codes, dtype=np.uint64)[order], order.astype(np.int64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_MUL) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], -1)


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, one row each (0 behind the end), and the lengths; a word start is a U+2581 in front."""
    lengths = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    out = np.zeros((len(words), lengths.max()), dtype=np.uint64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def _steps(codes: np.ndarray, lengths: np.ndarray, voc: Vocabulary):
    """(start, length, rows, piece numbers) of every piece that stands in a word; -1 is an unknown character."""
    for i in range(codes.shape[1]):
        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, min(voc.longest, codes.shape[1] - i) + 1):
            rows = np.flatnonzero(lengths >= i + n)
            if not len(rows):
                break
            h = h * _MUL + codes[:, i + n - 1] + np.uint64(1)
            numbers = voc.find(h[rows])
            hit = (numbers >= 0) | (n == 1)
            if hit.any():
                yield i, n, rows[hit], numbers[hit]


def forward(words: list[str], voc: Vocabulary, table: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language; table: piece x language, its last row for an unknown character."""
    out = np.zeros((len(words), table.shape[1]))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        codes, lengths = _matrix(["▁" + words[i] for i in part])
        out[part] = _forward(codes, lengths, voc, table)
    return out


def _forward(codes: np.ndarray, lengths: np.ndarray, voc: Vocabulary, table: np.ndarray) -> np.ndarray:
    width = codes.shape[1]
    reach = np.zeros((width + 1, len(codes), table.shape[1]))
    reach[0] = 1.0
    scale, gain = np.zeros(len(codes)), np.exp(PER_CHAR * np.arange(voc.longest + 1))
    seen = -1
    for i, n, rows, numbers in _steps(codes, lengths, voc):
        if i != seen:  # all that leads to i is in: bring it near 1, so that words of any length keep their precision
            seen, top = i, reach[i].max(axis=1)
            odd = np.flatnonzero((lengths > i) & ((top > 1e60) | (top < 1e-60)) & (top > 0))
            if len(odd):
                reach[i : i + voc.longest + 1, odd] /= top[odd][None, :, None]
                scale[odd] += np.log(top[odd])
        reach[i + n, rows] += reach[i, rows] * table[numbers] * gain[n]
    return np.log(np.maximum(reach[lengths, np.arange(len(codes))], 1e-290)) + scale[:, None] - PER_CHAR * lengths[:, None]


def fit_pieces(counts: dict[str, int], voc: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its word counts; the last entry is an unknown character.

    Every letter counts: words beyond ``FIT_SPAN`` are cut into spans, of which only the first has the word start.
    """
    size = len(voc.pieces)
    p = np.append(np.full(size, 1.0 / size), UNKNOWN)
    spans: dict[str, int] = {}
    for w, c in counts.items():
        w = "▁" + w
        for at in range(0, len(w), FIT_SPAN):
            spans[w[at : at + FIT_SPAN]] = spans.get(w[at : at + FIT_SPAN], 0) + c
    words = sorted(spans)
    if not words:
        return p
    parts = []
    words.sort(key=len)
    for at in range(0, len(words), 4096):
        part = words[at : at + 4096]
        codes, lengths = _matrix(part)
        parts.append((lengths, np.array([spans[w] for w in part], dtype=float), list(_steps(codes, lengths, voc))))
    for _ in range(rounds):
        expected = np.zeros(size + 1)
        for lengths, weight, steps in parts:
            ahead = np.zeros((lengths.max() + 1, len(lengths)))
            ahead[0] = 1.0
            gain = np.exp(PER_CHAR * np.arange(voc.longest + 1))
            for i, n, rows, numbers in steps:
                ahead[i + n, rows] += ahead[i, rows] * p[numbers] * gain[n]
            back = np.zeros_like(ahead)
            back[lengths, np.arange(len(lengths))] = 1.0
            for i, n, rows, numbers in reversed(steps):
                back[i, rows] += back[i + n, rows] * p[numbers] * gain[n]
            whole = ahead[lengths, np.arange(len(lengths))]
            for i, n, rows, numbers in steps:
                np.add.at(expected, numbers, weight[rows] * ahead[i, rows] * p[numbers] * gain[n] * back[i + n, rows] / whole[rows])
        kept = expected[:size] + SMOOTH
        p = np.append(kept / kept.sum() * (1 - UNKNOWN), UNKNOWN)
    return p


def fit(labelled: DataFrame, vocabulary_name: str = "piece_bpe_32k.model", fit_rows: int = FIT_ROWS) -> DataFrame:
    """lang, piece number, probability: about ``fit_rows`` distinct texts of each language, chosen by a hash of the text; all where it has fewer.

    The bound holds the fitted sample only; each language is one group of that size.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("_n"))
    picked = rows.join(guarded(sizes), "lang").where(share_of(F.col("text")) * F.col("_n") < fit_rows).select("lang", "text").distinct()

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        voc, counts = vocabulary(vocabulary_name), {}
        for t in pdf.text:
            for w in WORD.findall(t.lower()):
                counts[w] = counts.get(w, 0) + 1
        p = fit_pieces(counts, voc)
        at = np.flatnonzero(p > 0)
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "piece": at, "p": p[at]})

    return picked.groupBy("lang").applyInPandas(learn, "lang string, piece long, p double")


def identify(docs: DataFrame, labelled: DataFrame, vocabulary_name: str = "piece_bpe_32k.model", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``; learned from ``labelled`` (text, lang).

    lang_pred is ``und`` with score 0 where the text is null or has no letter, and where nothing could
    be learned. Ties go to the language that sorts first. Repeated rows each give their row, null
    ids stay null, other columns are ignored, an empty table gives an empty result. The model goes to
    the tasks as one array: pieces of the fixed vocabulary x languages.
    """
    model: dict[str, np.ndarray] = {}
    size = len(vocabulary(vocabulary_name).pieces) + 1
    for lang, piece, p in fit(labelled, vocabulary_name, fit_rows).toPandas().itertuples(index=False):
        model.setdefault(lang, np.zeros(size))[piece] = p
    langs = sorted(model)
    table = np.stack([model[x] for x in langs], axis=1) if langs else np.zeros((size, 0))
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float64))

    def run(batches):
        known: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            preds, best = [], []
            at = 0
            while at < len(texts):
                part, held = [], 0
                while at < len(texts) and (not part or held < 2_000_000):
                    part.append(texts[at] or "")
                    held += len(part[-1])
                    at += 1
                if len(known) > CACHE_WORDS:
                    known, scores = {}, np.zeros((0, len(langs)))
                found = [WORD.findall(t.lower()) for t in part] if langs else [[] for _ in part]
                new = list({w for words in found for w in words if w not in known})
                if new:
                    scores = np.concatenate((scores, forward(new, vocabulary(vocabulary_name), shared.value)))
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                for words in found:
                    if not any(any(map(str.isalpha, w)) for w in words):  # other numerals stand in words, too
                        preds.append("und")
                        best.append(0.0)
                        continue
                    total = scores[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
                    top = int(total.argmax())
                    preds.append(langs[top])
                    best.append(float(1.0 / np.exp(np.maximum(total - total[top], -700)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(best, pa.float64())], names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
