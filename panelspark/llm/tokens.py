"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where their encodings must agree.

The tokenizer splits a text before it merges bytes. No piece of its split has white space behind another character, so a place
between a visible character and an ASCII blank or line end is a piece boundary in any context: what is left of it is encoded alike
whatever follows, and what is right of it whatever precedes. Special strings hold no white space and can't span it either. Two
chunks are spliced at such a place of their overlap that both encodings show as a token boundary; where an overlap has
none, it is widened, in the end over the whole text.

Shorter texts are cut at all such places. Parts that occur again, in the same text or in others, are encoded once as long as the
counts of the parts seen fit into a table of fixed size.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many characters are cut, with chunks that overlap by OVERLAP at first.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Characters encoded by one call.
BATCH = 1 << 18
#: Parts whose counts a worker keeps, and characters of the longest one.
KNOWN, LONGEST = 1 << 19, 64
_BLANK = " \n\t\r"
#: What lies between proven boundaries: an ASCII blank behind a visible character begins a part, other white space does not.
_PART = re.compile(r"\s*\S+(?:[^\S \n\t\r]\s*\S*)*|\s+")


@lru_cache(maxsize=2)
def load(spec: str):
    """Tokenizer from the content of its file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def stable(text: str, low: int, high: int) -> Iterator[int]:
    """Proven piece boundaries inside (low, high), the middle ones first."""
    places = [p for p in range(low + 1, high) if text[p] in _BLANK and not text[p - 1].isspace()]
    middle = (low + high) / 2
    return iter(sorted(places, key=lambda p: abs(p - middle)))


def _boundaries(encoding, shift: int) -> tuple[list[int], set[int]]:
    starts = [a + shift for a, _ in encoding.offsets]
    return starts, {b + shift for _, b in encoding.offsets}


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, equal to those of encoding it at once."""
    n, total, done, first = len(text), 0, 0, 0
    end = min(n, chunk)
    starts, ends = _boundaries(tokenizer.encode(text[first:end], add_special_tokens=False), first)
    while end < n:
        width = overlap
        while True:
            low = max(done, end - width)
            if low <= done:  # no place in the whole chunk: make it longer
                end = min(n, end + max(chunk, end - done))
                starts, ends = _boundaries(tokenizer.encode(text[first:end], add_special_tokens=False), first)
                if end == n:
                    break
                width = overlap
                continue
            after = min(n, end + chunk)
            starts2, ends2 = _boundaries(tokenizer.encode(text[low:after], add_special_tokens=False), low)
            place = next((p for p in stable(text, low, end) if p in ends and p in ends2), None)
            if place is not None:
                total += sum(done <= s < place for s in starts)
                done, first, end, starts, ends = place, low, after, starts2, ends2
                break
            width *= 2
    return total + sum(s >= done for s in starts)


@lru_cache(maxsize=2)
def _known(spec: str) -> dict[str, int]:
    """Tokens of parts that this worker has seen."""
    return {}


def count(tokenizer, texts: list[str], known: dict[str, int] | None = None, limit: int = KNOWN) -> list[int]:
    """Tokens of each text. ``known`` has counts of parts by the same tokenizer; it is filled, and emptied beyond ``limit``."""
    out, waiting, size = [0] * len(texts), [], 0
    known = {} if known is None else known

    def flush():
        fresh = list({p for _, parts in waiting for p in parts if p not in known})
        if fresh:
            known.update(zip(fresh, map(len, tokenizer.encode_batch_fast(fresh, add_special_tokens=False))))
        for i, parts in waiting:
            out[i] = sum(map(known.__getitem__, parts))
        for p in fresh:
            if len(p) > LONGEST:
                del known[p]
        if len(known) > limit:
            known.clear()
        waiting.clear()

    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            out[i] = count_long(tokenizer, t)
            continue
        waiting.append((i, _PART.findall(t)))
        size += len(t)
        if size >= BATCH:
            flush()
            size = 0
    if waiting:
        flush()
    return out


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """Key, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row; null counts as empty, repeated rows are counted each.

    ``path`` is a tokenizer file of the driver, with byte-level splitting; its content goes to the tasks.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    pre = load(spec).pre_tokenizer
    if "ByteLevel" not in type(pre).__name__ or load(spec).normalizer is not None:
        raise ValueError("splicing is proven for byte-level splitting without normalizer only")
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = load(shared.value), _known(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(count(tokenizer, texts, known), pa.int64())],
                ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    counted = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
