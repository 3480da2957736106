"""Quality rules: text statistics and an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model of order four over code points, one for
each language, counted in Spark over all texts. Four code points of 16 bits are a 64-bit key
without collisions (those beyond the basic plane share the 6,400 of its private area), from
which context and lower orders follow by shifts, so counts, discounts and back-off weights are
DataFrame expressions. Every n-gram that a text holds was counted, so the model is a sorted
array of keys with the interpolated probabilities beside it, searched by bisection. Arrays are
broadcast in parts of a bounded number of n-grams: several languages, one, or a range of one.

`symbols="classes"` is a coarser model that can't grow: a byte is one of 32 symbols (see
`SYMBOLS`), so a language has 2^20 n-grams at most.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, ship, utf8

_SYMBOL_BITS = 5
_SYMBOLS = 1 << _SYMBOL_BITS
_ORDER = 4
_BLOCK = 1 << 12  # n-grams of a row of counts
_PIECE = 1 << 20  # bytes of a text that are looked at together


def _symbol_table() -> np.ndarray:
    """0 end or start of a line; 1 other white space and control; 2-27 letters; 28 capitals; 29 beyond ASCII; 30 . , ; : ! ? ( ) ' " -; 31 other signs and digits."""
    table = np.full(256, 31, np.uint8)
    table[:33] = 1
    table[10] = 0
    table[97:123] = np.arange(2, 28)
    table[65:91] = 28
    table[128:] = 29
    table[list(b".,;:!?()'\"-")] = 30
    return table


SYMBOLS = _symbol_table()

_SPACE = b" \t\n\x0b\x0c\r"
_SIGNS = b"#*$%&|<>"


def window_repeats(words: list[bytes], width: int = 8) -> int:
    """Words that stand in a window of `width` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += hashed[k : k + n]
    ordered = np.sort(rolled)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    slot = np.minimum(np.searchsorted(twice, rolled), len(twice) - 1)
    places = np.flatnonzero(twice[slot] == rolled).tolist()
    windows = [tuple(words[i : i + width]) for i in places]  # hashes only suggest; words decide
    count = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, window in zip(places, windows, strict=True):
        if count[window] > 1:
            covered[i] += 1
            covered[i + width] -= 1
    return int((np.cumsum(covered) > 0).sum())


def text_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole UTF-8 text."""
    words = text.split()
    spaces = len(text) - len(text.translate(None, _SPACE))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.decode("utf-8", "replace")) - spaces,
        len(text) - len(text.translate(None, _SIGNS)),
        len(lines) - len(set(lines)),
        window_repeats(words),
    )


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the order-four grams that end at each symbol of a text and at its end, in pieces."""
    for at in range(0, len(text) + 1, _PIECE):
        piece = np.zeros(min(_PIECE, len(text) + 1 - at) + _ORDER - 1, np.uint8)
        raw = np.frombuffer(text, np.uint8, min(_PIECE + _ORDER - 1, len(text) - max(0, at - _ORDER + 1)), max(0, at - _ORDER + 1))
        raw = raw[: len(piece) - max(0, _ORDER - 1 - at)]
        piece[max(0, _ORDER - 1 - at) :][: len(raw)] = SYMBOLS[raw]
        wide = piece.astype(np.int32)
        key = wide[: len(piece) - _ORDER + 1].copy()
        for k in range(1, _ORDER):
            key <<= _SYMBOL_BITS
            key |= wide[k : len(piece) - _ORDER + 1 + k]
        yield key


@dataclass
class KneserNey:
    """For each order: sorted hashes with discounted probabilities, sorted contexts with back-off weights."""

    hashes: list[np.ndarray]
    probabilities: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]

    @staticmethod
    def train(counts: np.ndarray) -> KneserNey:
        """From counts of all order-four grams, by hash."""
        by_order = [counts]
        for order in range(_ORDER - 1, 0, -1):  # how many symbols stand before the gram
            seen = counts.reshape([_SYMBOLS] * _ORDER).sum(axis=tuple(range(_ORDER - 1 - order))) if order < _ORDER - 1 else counts.reshape([_SYMBOLS] * _ORDER)
            by_order.append((seen > 0).sum(axis=0).ravel())
        model = KneserNey([], [], [], [])
        for c in reversed(by_order):
            c = c.astype(np.float64)
            n = [max(1.0, float((c == k).sum())) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            discounts = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), 0.95 * k) for k in (1, 2, 3)]
            taken = np.select([c == 0, c == 1, c == 2], [0.0, *discounts[:2]], discounts[2])
            table = c.reshape(-1, _SYMBOLS)
            total = table.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(total[:, None] > 0, (table - taken.reshape(table.shape)) / total[:, None], 0.0).ravel()
                weight = np.where(total > 0, taken.reshape(table.shape).sum(axis=1) / total, 1.0)
            found, known = np.flatnonzero(c), np.flatnonzero(total)
            model.hashes.append(found.astype(np.uint32))
            model.probabilities.append(p[found])
            model.contexts.append(known.astype(np.uint32))
            model.weights.append(weight[known])
        return model

    def log_probabilities(self) -> np.ndarray:
        """log10 of the probability of every order-four gram's last symbol, by hash: the sorted arrays laid out for direct access."""
        lower = np.full(1, 1.0 / _SYMBOLS)
        for order, (hashes, p, contexts, weights) in enumerate(zip(self.hashes, self.probabilities, self.contexts, self.weights, strict=True)):
            weight = np.ones(_SYMBOLS**order)
            weight[contexts] = weights
            spread = np.tile(lower, _SYMBOLS) if order else np.full(_SYMBOLS, lower[0])
            table = np.repeat(weight, _SYMBOLS) * spread
            table[hashes] += p
            lower = table
        return np.log10(lower).astype(np.float32)


_POINTS = 16  # bits of a code point in a key
_PRIVATE, _PRIVATE_SIZE = 0xE000, 6400
_LOW = (1 << 48) - 1


def point_grams(text: str) -> Iterator[np.ndarray]:
    """Keys of the order-four grams that end at each code point of a text and at its end, in pieces."""
    n = len(text) + 1
    for at in range(0, n, _PIECE):
        ahead = min(at, _ORDER - 1)
        raw = np.frombuffer(text[at - ahead : at + _PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        wide = np.zeros(_ORDER - 1 - ahead + len(raw) + (at + _PIECE >= n), np.uint64)
        wide[_ORDER - 1 - ahead :][: len(raw)] = np.where((raw > 0) & (raw < 1 << _POINTS), raw, _PRIVATE + raw % _PRIVATE_SIZE)
        size = len(wide) - _ORDER + 1
        key = wide[:size].copy()
        for k in range(1, _ORDER):
            key <<= np.uint64(_POINTS)
            key |= wide[k : k + size]
        yield key


def class_grams(text: str) -> Iterator[np.ndarray]:
    for keys in grams(text.encode("utf-8", "replace")):
        yield keys.astype(np.uint64)


_GRAMS = {"points": point_grams, "classes": class_grams}


def _language(lang_col: str) -> Column:
    """The language as a key that no null hides: '' for null, else the name after a sign."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))


def gram_counts(df: DataFrame, symbols: str = "points", text_col: str = "text", lang_col: str = "lang", at_once: int = 1 << 21) -> DataFrame:
    """(lang, key, n): how often each n-gram stands in all texts of a language.

    A task sums up to at_once n-grams in memory before it sends them; only sums are shuffled.
    """
    ship(df.sparkSession)
    take = _GRAMS[symbols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held = 0

        def rows(lang: str) -> pa.RecordBatch:
            keys, n = sums.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

        def settle() -> None:
            for lang, lists in waiting.items():
                keys, n = np.unique(np.concatenate(lists), return_counts=True)
                if lang in sums:
                    before, counted = sums[lang]
                    every, place = np.unique(np.concatenate([before, keys]), return_inverse=True)
                    keys, n = every, np.bincount(place, np.concatenate([counted, n]), len(every)).astype(np.int64)
                sums[lang] = keys, n.astype(np.int64)
            waiting.clear()

        for batch in batches:
            for lang, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for keys in take(cell.as_py().decode("utf-8", "replace")):
                    waiting.setdefault(lang, []).append(keys)
                    held += len(keys)
                if held > 1 << 22:
                    settle()
                    held = 0
                    if sum(len(k) for k, _ in sums.values()) > at_once:
                        yield from [rows(x) for x in list(sums)]
        settle()
        yield from [rows(x) for x in list(sums)]

    parts = df.select(_language(lang_col).alias("__lang"), utf8(text_col).alias("__utf8")).mapInArrow(run, "lang string, key bigint, n bigint")
    return parts.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts of an order's counts, kept within (0, k)."""
    n = [F.greatest(F.lit(1.0), F.count_if(F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    found = counts.groupBy("lang").agg(*n).withColumn("y", F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
    take = [F.least(F.lit(0.95 * k), F.greatest(F.lit(0.05), F.lit(float(k)) - F.lit(k + 1.0) * F.col("y") * F.col(f"n{k + 1}") / F.col(f"n{k}"))).alias(f"d{k}") for k in (1, 2, 3)]
    return found.select("lang", *take)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, key, p): the interpolated probability of the last code point of each counted n-gram.

    counts: (lang, key, n) of order four. The counts of a lower order are those of the distinct
    code points that stand before its n-grams.
    """
    orders = [counts.select("lang", "key", "n")]
    for order in range(_ORDER - 1, 0, -1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << _POINTS * order) - 1))
        orders.append(orders[-1].groupBy("lang", shorter.alias("key")).agg(F.count(F.lit(1)).alias("n")))
    # A row of discounts for each language: broadcast where their number has been seen to be small.
    few = counts.select("lang").distinct().count() <= 100_000
    lower = None
    for order, table in enumerate(reversed(orders)):
        kept = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        discounts = _discounts(table)
        rows = table.join(F.broadcast(discounts) if few else discounts, "lang").select("lang", "key", "n", kept.alias("d"), F.shiftrightunsigned("key", _POINTS).alias("context"))
        sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("off"), F.count(F.lit(1)).alias("kinds"))
        rows = rows.join(sums, ["lang", "context"]).select("lang", "key", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"), (F.col("off") / F.col("total")).alias("weight"), "kinds")
        if lower is None:  # one context, the empty one: below it, all code points of the language are equally likely
            lower = rows.select("lang", "key", (F.col("own") + F.col("weight") / F.col("kinds")).alias("p"))
        else:
            rows = rows.withColumn("tail", F.col("key").bitwiseAND(F.lit((1 << _POINTS * order) - 1)))
            lower = rows.join(lower.select("lang", F.col("key").alias("tail"), "p"), ["lang", "tail"]).select("lang", "key", (F.col("own") + F.col("weight") * F.col("p")).alias("p"))
    return lower


def _class_model(counts: DataFrame) -> DataFrame:
    """kneser_ney() over byte classes; a language is one task's work, its 2^20 n-grams being a bound."""

    def train(table: pa.Table) -> pa.Table:
        keys = table["key"].to_numpy()
        dense = np.zeros(_SYMBOLS**_ORDER, np.int64)
        dense[keys] = table["n"].to_numpy()
        p = 10.0 ** KneserNey.train(dense).log_probabilities()[keys].astype(float)
        return pa.table({"lang": table["lang"], "key": table["key"], "p": pa.array(p)})

    return counts.groupBy("lang").applyInArrow(train, "lang string, key bigint, p double")


@dataclass
class Part:
    """Languages whose texts are scored together, and the range of keys of which the arrays are."""

    languages: list[str]
    low: int | None = None
    high: int | None = None

    def arrays(self, model: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        rows = model.where(F.col("lang").isin(self.languages))
        if self.low is not None:
            rows = rows.where(F.col("key").between(self.low, self.high))
        table = rows.select("lang", "key", F.log10("p").cast("float").alias("p")).toArrow()
        langs, keys, p = table["lang"].to_pandas(), table["key"].to_numpy().view(np.uint64), table["p"].to_numpy()
        found = {}
        for lang in self.languages:
            own = np.flatnonzero((langs == lang).to_numpy())
            own = own[np.argsort(keys[own])]
            found[lang] = keys[own], p[own]
        return found


def parts_of(model: DataFrame, most_grams: int) -> list[Part]:
    """The model in parts of at most about most_grams n-grams."""
    sizes = sorted((r["n"], r["lang"]) for r in model.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    parts, room = [], 0
    for n, lang in sizes:
        if n > most_grams:
            cuts = -(-n // most_grams)
            quantiles = [k / cuts for k in range(1, cuts)]
            inner = model.where(F.col("lang") == lang).agg(F.percentile_approx("key", quantiles, 100 * cuts).alias("q")).first()["q"]
            edges = [-(1 << 63), *sorted(set(inner)), 1 << 63]
            parts += [Part([lang], a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]
        elif n <= room:
            parts[-1].languages.append(lang)
            room -= n
        else:
            parts.append(Part([lang]))
            room = most_grams - n
    return parts


def log_probability(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> float:
    """The sum over those of the keys that the table holds."""
    known, p = table
    if not len(known):
        return 0.0
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return float(p[place][known[place] == keys].sum(dtype=np.float64))


def _scored(df: DataFrame, part: Part, model: DataFrame, symbols: str, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(part.arrays(model))
    take = _GRAMS[symbols]
    ids = [id_col, *(["__row"] if part.low is not None else [])]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids)
    names = [*ids, "__lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "surprise", "length"]
    schema = f"{kinds}, __lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, surprise double, length bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, surprise, lengths = [], [], []
            for lang, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = cell.as_py()
                text = raw.decode("utf-8", "replace")
                stats.append(text_statistics(raw))
                lengths.append(len(text) + 1)
                surprise.append(-sum(log_probability(keys, shared.value[lang]) for keys in take(text)) / lengths[-1])
            columns = [pa.array(c, pa.int64()) for c in zip(*stats, strict=True)] if stats else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), *columns, pa.array(surprise, pa.float64()), pa.array(lengths, pa.int64())], names=names)

    rows = df.select(_language(lang_col).alias("__lang"), utf8(text_col).alias("__utf8"), *ids)
    return rows.where(F.col("__lang").isin(part.languages)).mapInArrow(run, schema)


def text_scores(df: DataFrame, model: DataFrame, symbols: str, id_col: str, text_col: str, lang_col: str, most_grams: int) -> DataFrame:
    """Statistics and surprise (mean -log10 probability of a symbol) of every row's text.

    A row is scored in the pass of its language's part. The texts of a language whose model has
    several parts are written once with row numbers, by which their partial sums meet.
    """
    parts = parts_of(model, most_grams)
    whole = [p for p in parts if p.low is None]
    cut = sorted({p.languages[0] for p in parts if p.low is not None})
    out = [_scored(df, p, model, symbols, id_col, text_col, lang_col) for p in whole]
    if cut:
        rows = df.where(_language(lang_col).isin(cut)).select(id_col, F.col(lang_col), F.col(text_col), F.monotonically_increasing_id().alias("__row"))
        rows = Scratch(df.sparkSession, "rules").write(rows, "rows")
        each = [_scored(rows, p, model, symbols, id_col, text_col, lang_col) for p in parts if p.low is not None]
        sums = functools.reduce(DataFrame.unionByName, each).groupBy("__row")
        firsts = [F.first(c).alias(c) for c in each[0].columns if c not in ("__row", "surprise")]
        out.append(sums.agg(F.sum("surprise").alias("surprise"), *firsts).select(*[c for c in each[0].columns if c != "__row"]))
    if not out:
        return _scored(df, Part([]), model, symbols, id_col, text_col, lang_col)
    return functools.reduce(DataFrame.unionByName, out)


def apply_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 20,
    repeat_percent: int = 30,
    word_reach: float = 2.0,
    symbol_reach: float = 3.0,
    length_power: float = 0.5,
    symbols: str = "points",
    most_grams: int = 4_000_000,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, lang) for every row.

    A row is kept unless its text has fewer than min_words words, more than repeat_percent per
    cent of them in repeated windows, or a perplexity, for each word or for each symbol, outside
    its language's band: its logarithm's distance from the language's median, times the number
    of words or symbols to the power `length_power` (a short text's perplexity scatters more),
    lies from the lower quartile less word_reach or symbol_reach quartile ranges to the upper
    one and as many more. Medians and quartiles are those of all rows of the language that the
    other rules keep. The column perplexity is that for each symbol.
    Rows without a language share a model and a band. Null and empty texts have no words and
    fail. Texts of any length are scored whole. Every row gives one row, repeated rows equal
    ones; further columns are left out; an empty table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "rules")
    counts = scratch.write(gram_counts(df, symbols, text_col, lang_col), "counts")
    model = scratch.write(kneser_ney(counts) if symbols == "points" else _class_model(counts), "model")
    scored = scratch.write(text_scores(df, model, symbols, id_col, text_col, lang_col, most_grams), "scored")
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(repeat_percent) * F.col("n_words"))
    scored = scored.withColumns({"base_failed": failed, "__s": F.col("surprise"), "__w": F.try_divide(F.col("surprise") * F.col("length"), F.col("n_words"))})
    passed = lambda c: F.when(~F.col("base_failed"), F.col(c))
    medians = scored.groupBy("__lang").agg(*[F.percentile_approx(passed(f"__{c}"), 0.5, 10_000).alias(f"__median_{c}") for c in "sw"])
    spread = {"s": "length", "w": "n_words"}
    off = {f"__off_{c}": (F.col(f"__{c}") - F.col(f"__median_{c}")) * F.pow(F.col(n).cast("double"), F.lit(length_power)) for c, n in spread.items()}
    scored = scored.join(medians, "__lang").withColumns(off)
    bands = scored.groupBy("__lang").agg(*[F.percentile_approx(passed(f"__off_{c}"), [0.25, 0.75], 10_000).alias(f"__q_{c}") for c in "sw"])
    inside = F.lit(True)
    for c, reach in (("s", symbol_reach), ("w", word_reach)):
        low, high = F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]
        margin = F.lit(reach) * F.greatest(high - low, F.lit(1e-2))
        inside = inside & F.col(f"__off_{c}").between(low - margin, high + margin)
    return scored.join(bands, "__lang").select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        F.pow(F.lit(10.0), F.col("surprise")).alias("perplexity"),
        F.when(F.col("__lang") != "", F.substring("__lang", 2, 1 << 30)).alias("lang"),
    )
