"""Token counts with a public tokenizer, huge documents by overlap resynchronisation.

A document longer than `window` characters is encoded as overlapping chunks, with offsets.
Two neighbouring chunks are spliced at a common token boundary p that is proven stable: the
character before p is a letter and the one at p white space. No piece of the byte-level
pre-tokenizer's pattern, and no added token, holds a letter followed by white space, so
every encoding of any text around p breaks there, and matching goes on from p as if the text
began there. Where an overlap has no such boundary that both chunks show, it is widened, at
last to the whole rest of the document.
"""

from __future__ import annotations

import bisect
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import no_clash, ship, utf8

_LOADED: dict[str, object] = {}


def load_tokenizer(vocabulary: str):
    """A tokenizers.Tokenizer from a .json file, named by path or by its name among the public tokenizers."""
    if vocabulary not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        path = vocabulary
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[vocabulary] = tokenizer
    return _LOADED[vocabulary]


def splits_at_white_space(tokenizer) -> bool:
    """Whether the stable boundary is proven for this tokenizer: byte-level pieces by the standard pattern of the
    text as it is, and no added token that holds a letter before white space or takes white space with it."""
    parts = json.loads(tokenizer.to_str())
    pieces = parts.get("pre_tokenizer") or {}
    plain = parts.get("normalizer") is None and pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not pieces.get("add_prefix_space")
    return bool(plain) and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"[^\W\d_]\s", t["content"]) for t in parts.get("added_tokens", []))


class _Chunk:
    """One encoded chunk: where each of its tokens starts and ends in the document."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        offsets = tokenizer.encode(text[start:end], add_special_tokens=False).offsets
        self.start, self.end = start, end
        self.begins = [start + a for a, _ in offsets]
        self.ends = [start + b for _, b in offsets]

    def tokens_before(self, p: int) -> int | None:
        """How many tokens end at or before p; None if a token lies across p."""
        k = bisect.bisect_right(self.ends, p)
        return k if k == len(self.ends) or self.begins[k] >= p else None


def _stable(text: str, p: int) -> bool:
    return text[p - 1].isalpha() and text[p].isspace()


def splice_point(text: str, left: _Chunk, right: _Chunk, after: int) -> int | None:
    """The last stable boundary that both chunks show inside their overlap, beyond `after`."""
    for p in range(left.end - 1, max(right.start, after), -1):
        if _stable(text, p) and left.tokens_before(p) is not None and right.tokens_before(p) is not None:
            return p
    return None


def count_by_chunks(tokenizer, text: str, window: int, overlap: int) -> int:
    """Tokens of the whole text, equal to len(tokenizer.encode(text)), without encoding it at once."""
    total, spliced = 0, 0
    left = _Chunk(tokenizer, text, 0, min(window, len(text)))
    while left.end < len(text):
        reach, p = overlap, None
        while p is None and reach < left.end - spliced:
            start = left.end - reach
            right = _Chunk(tokenizer, text, start, min(start + max(window, 2 * reach), len(text)))
            p = splice_point(text, left, right, spliced)
            reach *= 2
        if p is None:  # no stable boundary so far: take more into the left chunk
            left = _Chunk(tokenizer, text, left.start, min(left.end + (left.end - left.start), len(text)))
            continue
        total += left.tokens_before(p) - left.tokens_before(spliced)
        left, spliced = right, p
    return total + len(left.ends) - left.tokens_before(spliced)


def count_tokens(
    df: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    window: int = 1 << 16,
    overlap: int = 1 << 10,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row: UTF-8 bytes and tokens of the whole text.

    Texts longer than `window` are encoded in chunks if the tokenizer is one for which that is
    proven (splits_at_white_space), else whole. Null and empty texts have 0 of both. No begin, end or added tokens, no truncation or
    padding; special strings inside a text are handled as the library does by default. Ids may
    be null or repeat; every row gives one row, and further columns are left out. id_col must not
    be named like an output.
    """
    no_clash(id_col, "n_bytes", "n_tokens", "over_limit")
    ship(df.sparkSession)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(vocabulary)
        in_chunks = splits_at_white_space(tokenizer)
        for batch in batches:
            column = batch.column(1)
            sizes, counts = [0] * len(column), [0] * len(column)
            group: list[tuple[int, str]] = []
            held = 0

            def flush():
                for (i, _), enc in zip(group, tokenizer.encode_batch_fast([t for _, t in group], add_special_tokens=False), strict=True):
                    counts[i] = len(enc)
                group.clear()

            for i, cell in enumerate(column):
                raw = cell.as_py()
                sizes[i] = len(raw)
                text = raw.decode("utf-8", "replace")
                if in_chunks and len(text) > window:
                    counts[i] = count_by_chunks(tokenizer, text, window, overlap)
                    continue
                group.append((i, text))
                held += len(text)
                if held > 1 << 18:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    counted = df.select(F.col(id_col), utf8(text_col).alias("__text")).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
