"""Token counts: batch encoding inside Arrow functions that return lengths only.

A text is cut at blanks that the tokenizer itself treats as token borders, the pieces are counted once per
distinct piece in batches balanced by bytes, and a text's count is the sum over its pieces. Which
cuts are safe depends on the vocabulary:

- ``word`` (BPE with word ends, blanks dropped): every space, tab and newline; a piece's count is the same wherever it stands.
- other files: whole texts are encoded; nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import map_arrow, text_or_empty

#: Distinct pieces remembered by a worker before it starts anew.
CACHE_PIECES = 400_000
BATCH_BYTES = 1 << 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCounter:
    """Counts for a tokenizer that drops blanks; remembers pieces up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        at = 0
        while at < len(pieces):
            batch, size = [], 0
            while at < len(pieces) and (not batch or size + len(pieces[at]) <= BATCH_BYTES):
                batch.append(pieces[at])
                size += len(pieces[at])
                at += 1
            found = self.tokenizer.encode_batch_fast([p.decode() for p in batch], add_special_tokens=False)
            self.known.update(zip(batch, map(len, found), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
        # ASCII blanks only, and never U+001C to U+001F, which str.split() would also take
        split = [t.encode().split() for t in texts]
        new = list({p for pieces in split for p in pieces if p not in known})
        self._learn(new)
        return [sum(map(known.__getitem__, pieces)) for pieces in split]


class SentencePieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.processor.encode(texts, num_threads=1)]


class WholeTextCounter(WordCounter):
    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def counter(name: str):
    path = vocabulary_path(name)
    if name.endswith(".model"):
        return SentencePieceCounter(path)
    return WordCounter(path) if name.startswith("word_") else WholeTextCounter(path)


def balanced(texts: list[str], size: int = BATCH_BYTES) -> Iterator[list[str]]:
    batch, held = [], 0
    for t in texts:
        if batch and held + len(t) > size:
            yield batch
            batch, held = [], 0
        batch.append(t)
        held += len(t)
    if batch:
        yield batch


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null and empty texts count 0. Repeated rows and null ids each give their row. Other columns of
    ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    """

    def run(batches):
        count = None
        for batch in batches:
            count = count or counter(vocabulary)
            texts = batch.column(2).to_pylist()
            lengths = [n for part in balanced(texts) for n in count.count(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
