"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage in k = floor(error_rate * m) edits. Cut
into k + 1 pieces, at least one piece of it stands unchanged in such a passage, so one
Aho-Corasick pass over a document finds all places worth a look; each is verified with Myers'
bit-parallel edit distance of the whole item against the stretch of text around it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.common import Scratch, own_name, own_names, plain_names, row_key, ship, utf8

#: ASCII characters that aren't letters or digits part words; case is folded before.
_PARTS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def normalise(text: bytes) -> str:
    """Lower case, words parted by one space, ASCII punctuation and white space dropped."""
    lowered = text.decode("utf-8", "replace").lower().encode("utf-8", "replace")
    return b" ".join(lowered.translate(_PARTS).split()).decode("utf-8", "replace")


def cut(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 consecutive pieces of the item, with their offsets."""
    n, count = len(item), errors + 1
    edges = [round(i * n / count) for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:]) if b > a]


class Pattern:
    """An item prepared for Myers' algorithm."""

    def __init__(self, item: str):
        self.item, self.mask, self.high = item, (1 << len(item)) - 1, 1 << (len(item) - 1)
        self.places: dict[str, int] = {}
        for i, c in enumerate(item):
            self.places[c] = self.places.get(c, 0) | (1 << i)

    def best(self, text: str) -> tuple[int, int]:
        """Least edit distance of the whole item to any stretch of text, and where the first such one ends."""
        at = text.find(self.item)
        if at >= 0:
            return 0, at + len(self.item)
        up, down, score = self.mask, 0, len(self.item)
        least, end = score, 0
        places, mask, high = self.places, self.mask, self.high
        for j, c in enumerate(text, 1):
            eq = places.get(c, 0)
            vertical = eq | down
            across = (((eq & up) + up) ^ up) | eq
            plus = (down | ~(across | up)) & mask
            minus = up & across
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
            plus = (plus << 1) & mask
            minus = (minus << 1) & mask
            up = (minus | ~(vertical | plus)) & mask
            down = plus & vertical
            if score < least:
                least, end = score, j
        return least, end


class Matcher:
    """Finds all of a block of items in one pass over a text."""

    def __init__(self, items: list[tuple[object, str, int]]):
        import ahocorasick

        self.items = [(key, Pattern(text), errors) for key, text, errors in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, errors) in enumerate(items):
            for offset, piece in cut(text, errors):
                pieces.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(key, edits, item length, end) of the best match of each item that the text holds within its error budget."""
        if self.empty:
            return []
        starts: dict[int, set[int]] = {}
        for last, (length, owners) in self.automaton.iter(text):
            for number, offset in owners:
                starts.setdefault(number, set()).add(last + 1 - length - offset)
        found = []
        for number, places in starts.items():
            key, pattern, errors = self.items[number]
            if not errors:  # too short for an edit: only whole words count
                size = len(pattern.item)
                places = {p for p in places if (p == 0 or text[p - 1] == " ") and text[p + size : p + size + 1] in ("", " ")}
            best = (errors + 1, 0)
            ordered = sorted(places)
            i = 0
            while i < len(ordered) and best[0]:
                j = i  # starts this close lie in one stretch
                while j + 1 < len(ordered) and ordered[j + 1] - ordered[j] <= 2 * errors:
                    j += 1
                low = max(0, ordered[i] - errors)
                edits, end = pattern.best(text[low : ordered[j] + len(pattern.item) + errors])
                if edits < best[0]:
                    best = (edits, low + end)
                i = j + 1
            if best[0] <= errors:
                found.append((key, best[0], len(pattern.item), best[1]))
        return found


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = 0.08,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """(id, item, edits, item_chars, match_end) for each row of df and each item that it holds.

    Texts and items are compared as normalise() leaves them; match_end is a place in that form.
    Items without a letter or digit (null and empty ones too) match nothing, and items too short
    for an edit only match as whole words. Null and empty texts hold nothing; texts of any
    length are searched whole. Items are taken in
    blocks of about block_chars characters, each broadcast and matched in a pass over df, so the
    broadcast is bounded however many items there are. A repeated row repeats its matches; an
    empty table on either side gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    # Normalised text, being driver-side Python, is derived from each block as it is collected.
    sized = benchmark.select(F.col(item_col).alias("__item"), F.col(item_text_col).alias("__text")).where(F.col("__text").isNotNull())
    chars = sized.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, edits int, item_chars int, match_end bigint"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    texts = df.select(F.col(id_col), utf8(text_col).alias("__utf8"))
    results = []
    for block in range(blocks):
        part = sized.where(F.pmod(F.xxhash64("__text"), F.lit(blocks)) == block) if blocks > 1 else sized
        items = []
        for row in part.collect():
            text = normalise(row["__text"].encode())
            if text:
                items.append((row["__item"], text, int(error_rate * len(text))))
        results.append(texts.mapInArrow(_scan(spark.sparkContext.broadcast(items), id_col, item_col, item_type), schema))
    out = results[0]
    for other in results[1:]:
        out = out.unionAll(other)
    return out


def _scan(shared, id_col: str, item_col: str, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            rows, hits = [], []
            for i, cell in enumerate(batch.column(1)):
                for hit in matcher.find(normalise(cell.as_py())):
                    rows.append(i)
                    hits.append(hit)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            columns = [[h[k] for h in hits] for k in range(4)]
            kinds = (item_type, pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns, kinds)], names=[id_col, item_col, "edits", "item_chars", "match_end"])

    return run


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that hold no benchmark item. A row is known by id and text, so null and repeated ids are no matter.

    df may have columns of any name. The hits are written first: their size is then known, and Spark broadcasts them if they are
    few and joins by shuffle if they aren't.
    """
    names, df = df.columns, own_names(df)
    id_col, text_col = own_name(id_col), own_name(text_col)
    keyed = df.select(row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    hit = contaminated(keyed, benchmark, "__key", "__text", **options).select(F.col("__key").alias("__hit")).distinct()
    hit = Scratch(df.sparkSession, "hits").write(hit, "hits")
    key, found = row_key(id_col, text_col), F.col("__hit")
    same = key["id"].eqNullSafe(found["id"]) & (key["long"] == found["long"]) & (key["short"] == found["short"])
    return df.join(hit, same, "left_anti").select(*plain_names(names))
