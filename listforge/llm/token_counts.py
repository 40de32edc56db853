"""Token counts: batch encoding that returns lengths only.

Texts arrive in Arrow batches, are cut into slices of about the same number of bytes, and only the
number of tokens leaves the task.  A sentencepiece BPE model whose pieces never continue over a space
encodes every word on its own, so texts are split there (the safe boundary) and a word that was seen
before is not encoded again.  Whether a model allows that is tested when it is loaded; other models
get whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import byte_slices

SEGMENT = 1_000_000
MEMO = 400_000
_LOADED: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    """An existing file, or the name of a public tokenizer."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Pieces:
    """Lengths by a sentencepiece model."""

    CHUNK = re.compile(" *[^ ]+| +")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        shown = lambda text: self.model.encode(text, out_type=str)
        self.by_word = (not any(re.search("[^▁]▁", p) for p in pieces) and not any("\n" in p for p in pieces)
                        and shown("a") == ["▁a"] and shown("\n") == ["▁", "<0x0A>"] and shown("a ") == ["▁a", "▁"]
                        and "".join(shown("a  b")) == "▁a▁▁b" and "".join(shown(" ﬁ\té ")) == "▁▁ﬁ<0x09>é▁")
        self.memo: dict[str, int] = {}

    def word(self, chunk: str) -> int:
        """Tokens of one chunk, which starts with the mark for a space.  A line end stands alone as a
        byte token, so what follows it is counted with it, less the mark."""
        head, *rest = chunk.split("\n")
        n = self.known(head) if head else 1 if rest else 0
        return n + sum(self.known("\n" + part) - 1 for part in rest)

    def known(self, chunk: str) -> int:
        n = self.memo.get(chunk)
        if n is None:
            n = len(self.model.encode(chunk))
            if len(chunk) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[chunk] = n
        return n

    def chunks(self, text: str) -> int:
        total = 0
        for m in self.CHUNK.finditer(text):
            chunk = m.group()
            total += 1 if m.start() and chunk == " " else self.word(chunk[1:] if m.start() else chunk)
        return total

    def count(self, text: str) -> int:
        if not self.by_word:
            return len(self.model.encode(text))
        if not text:
            return 0
        text = text.replace("▁", " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return self.chunks(text)
        total, known, word = 0, self.memo.get, self.word
        for part in segments(text):
            for w in part.split(" "):
                n = known(w)
                total += word(w) if n is None else n
        return total

    def counts(self, texts: list[str]) -> list[int]:
        return [self.count(t) for t in texts]


class Merges:
    """Lengths by a tokenizers file; whole texts, without special tokens, truncation or padding."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch(texts, add_special_tokens=False)]


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Cut a text that has single spaces only at spaces, about every ``size`` characters; the space goes."""
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def load(name: str):
    if name not in _LOADED:
        path = tokenizer_path(name)
        _LOADED[name] = (Pieces if path.endswith(".model") else Merges)(path)
    return _LOADED[name]


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096, id_column: str = "doc_id",
                 text_column: str = "text", slice_bytes: int = 2_000_000) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Null reads as the empty text (0 bytes, 0 tokens); repeated rows stay; other columns are not read.
    A text of any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        for batch in batches:
            for part in byte_slices(batch, "text", slice_bytes):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64()),
                     pa.array(model.counts(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return (rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
