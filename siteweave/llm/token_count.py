"""Token counts of whole texts by a public tokenizer, in Arrow batches."""

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.common import table, texts_of

#: A space between two characters that are neither a space nor its stand-in in the
#: vocabulary. No piece goes on past a space, and the encoder puts a space before what it
#: gets, so "a" and "b" together have the tokens of "a b".
SAFE = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")
#: Bytes of segments that go to the encoder in one call.
CALL_BYTES = 1 << 20
#: Segments whose counts a task remembers at once, and the longest that it remembers.
REMEMBERED = 400_000
SHORT = 64


def segments_of(text: str) -> list[str]:
    """The text cut at its safe boundaries."""
    if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
        return SAFE.split(text)
    return text.split(" ")


class Counter:
    """Token counts by sentencepiece. Segments are encoded in calls of about CALL_BYTES
    bytes; a segment met again is not encoded again."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_file)
        self.known: dict[str, int] = {}

    def learn(self, segments: set[str]) -> None:
        call, size = [], 0
        for segment in segments:
            call.append(segment)
            size += len(segment) + 16
            if size >= CALL_BYTES:
                self._encode(call)
                call, size = [], 0
        self._encode(call)

    def _encode(self, call: list[str]) -> None:
        if call:
            self.known.update(zip(call, map(len, self.model.encode(call, num_threads=1)), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        parts = [segments_of(text) for text in texts]
        new = set().union(*parts).difference(self.known) if parts else set()
        self.learn(new)
        got = [sum(map(self.known.__getitem__, p)) if text else 0 for p, text in zip(parts, texts, strict=True)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        else:
            for segment in [s for s in new if len(s) > SHORT]:
                del self.known[segment]
        return got


def by_bytes(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters each; a longer text is a range of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > most:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def count_tokens(
    docs: DataFrame, model_file: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Tokens of each text as the library counts them, without begin and end tokens.

    Texts are cut at spaces that no token crosses, so that a text of any length is encoded
    in pieces, and the pieces go to the encoder in batches of even bytes; only their
    lengths come back. A text that the cut can't split (no single space) is encoded whole.

    Returns one row per row: doc_id, n_bytes, n_tokens, over_limit. Null and empty texts
    have 0 bytes and 0 tokens; bytes that are no UTF-8 count as U+FFFD; no rows give none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_file)
        for batch in batches:
            raw = texts_of(batch.column(1))
            texts = [b.decode("utf-8", "replace") if b else "" for b in raw]
            tokens: list[int] = []
            for start, end in by_bytes(texts, 4 * CALL_BYTES):
                tokens += counter.counts(texts[start:end])
            sizes = [len(b) if b else 0 for b in raw]
            over = [n > limit for n in tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under the 32k piece vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
