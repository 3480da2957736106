"""Language identification, words first, with back-off to ever shorter character n-grams.

A known word scores, in each language, the logarithm of its smoothed share of the
language's words. An unseen one scores the mean over those of its longest n-grams that are
known, n falling from four to one; only where not even a letter is known does it say nothing.
A text's scores are sums over its words, its language the one with the greatest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomgraph.llm.common import Scratch, no_clash, ship, utf8

#: Runs of letters (and of what Unicode counts as numeric but no digit).
_LETTERS = re.compile(r"[^\W\d_]+")
_LONGEST = 4
_ORDERS = (0, *range(_LONGEST, 0, -1))  # words, then ever shorter n-grams
_SEED = 42  # Spark's xxhash64 of one string is XXH64 of its UTF-8 bytes with this seed


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked; its plain letters for n = 1."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Entries:
    """One order's entries: sorted 64-bit hashes and, for each, the languages that have it and what they gain by it."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, which: np.ndarray, gains: np.ndarray):
        self.hashes, self.starts, self.which, self.gains = hashes, starts, which, gains

    def find(self, entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the entries are known, and the places of those."""
        if not len(self.hashes):
            return np.zeros(len(entries), bool), np.zeros(0, np.int64)
        wanted = np.array([xxh64_intdigest(e.encode("utf-8", "replace"), _SEED) for e in entries], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        known = self.hashes[at] == wanted
        return known, at[known]

    def __contains__(self, entry: str) -> bool:
        return bool(self.find([entry])[0][0])

    def gained(self, places: np.ndarray, owners: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """(owner, language): sums of the gains at the places of each owner."""
        starts, sizes = self.starts[places], self.starts[places + 1] - self.starts[places]
        cells = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        at = np.repeat(owners, sizes) * shape[1] + self.which[cells]
        return np.bincount(at, self.gains[cells], shape[0] * shape[1]).reshape(shape)


_NONE = Entries(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))


class Model:
    """Languages and, for words (order 0) and n-grams (order n), each entry's log-shares by language.

    A log-share is floors[order], what a language gives to an entry that it has not, plus a gain
    that is kept only where a language has the entry: the size is that of what was seen, not of
    entries times languages.
    """

    def __init__(self, languages: list[str], entries: dict[int, Entries], floors: dict[int, np.ndarray]):
        self.languages = languages
        self.index = [entries.get(order, _NONE) for order in range(_LONGEST + 1)]
        self.floors = [floors.get(order, np.zeros(len(languages))) for order in range(_LONGEST + 1)]

    def rows(self, words: list[str], orders: tuple[int, ...] = _ORDERS) -> np.ndarray:
        """(word, language): what each word says, by the first of the orders that knows it or a gram of it."""
        out, left = np.zeros((len(words), len(self.languages)), np.float32), np.arange(len(words))
        for order in orders:
            if not len(left):
                break
            grams = [[words[j]] if order == 0 else grams_of(words[j], order) for j in left]
            known, places = self.index[order].find(list(chain.from_iterable(grams)))
            owners = np.repeat(np.arange(len(left)), list(map(len, grams)))[known]
            hits = np.bincount(owners, minlength=len(left))
            found = hits > 0
            sums = self.index[order].gained(places, owners, (len(left), len(self.languages)))
            out[left[found]] = self.floors[order] + sums[found] / hits[found, None]
            left = left[~found]
        return out

    def unseen(self, word: str) -> np.ndarray:
        return self.rows([word], _ORDERS[1:])[0]


class StoredModel:
    """A model whose entries, (order, hash, cells of (language, gain)), are a table: texts meet them by joins."""

    def __init__(self, languages: list[str], entries: DataFrame, floors: dict[int, np.ndarray], scratch: Scratch):
        self.languages, self.entries, self.scratch = languages, entries, scratch
        self.floors = [floors.get(order, np.zeros(len(languages))) for order in range(_LONGEST + 1)]


def _decided(languages: list[str], total: np.ndarray) -> tuple[str, float]:
    best = int(total.argmax())  # the first of equals, languages being sorted
    return languages[best], float(1.0 / np.exp(total - total[best]).sum())


def _counted_words(text: str) -> Counter:
    """A text's words; none if it has no letter."""
    words = Counter(words_of(text))
    return words if any(map(str.isalpha, text)) else Counter()


class Scorer(dict):
    """Word to row of one table, filled as words come, up to a bound."""

    def __init__(self, model: Model, most_words: int = 200_000, most_cells: int = 4_000_000):
        super().__init__()
        self.model = model
        self.most = max(1, min(most_words, most_cells // max(1, len(model.languages))))
        self.letters = most_cells // max(1, len(model.languages))  # of words that are looked up at once
        self.table = np.zeros((self.most, len(model.languages)), np.float32)

    def learn(self, words: list[str]) -> None:
        """Rows for words that have none, in runs of few letters, as each gives all its grams at once."""
        at = 0
        while at < len(words):
            end, letters = at + 1, len(words[at])
            while end < len(words) and letters + len(words[end]) <= self.letters:
                letters += len(words[end])
                end += 1
            self.table[len(self) : len(self) + end - at] = self.model.rows(words[at:end])
            self.update(zip(words[at:end], range(len(self), len(self) + end - at)))
            at = end

    def predict(self, text: str) -> tuple[str, float]:
        words = _counted_words(text)
        if not words or not self.model.languages:
            return "und", 0.0
        total = np.zeros(len(self.model.languages))
        step = max(1, min(self.most // 4, 1 << 14))
        seen, times = list(words), np.fromiter(words.values(), float, len(words))
        for i in range(0, len(seen), step):
            some = seen[i : i + step]
            if len(self) + len(some) > self.most:
                self.clear()
            self.learn([w for w in some if w not in self])
            total += times[i : i + step] @ self.table[[self[w] for w in some]]
        return _decided(self.model.languages, total)


def _counted(sample: DataFrame, longest_entry: int) -> DataFrame:
    """(order, hash, lang, n) of the sample's words and n-grams, summed in each task and then by shuffle; words too long to be entries have no hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words.setdefault(lang, Counter()).update(words_of(cell.as_py().decode("utf-8", "replace")))
            for lang, seen in words.items():
                orders = [Counter(seen)] + [Counter() for _ in range(_LONGEST)]
                for word, n in seen.items():
                    for order in range(1, _LONGEST + 1):
                        for gram in grams_of(word, order):
                            orders[order][gram] += n
                for order, table in enumerate(orders):
                    size = len(table)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([order] * size, pa.int32()), pa.array(list(table.keys()), pa.string()), pa.array([lang] * size, pa.string()), pa.array(list(table.values()), pa.int64())],
                        names=["order", "entry", "lang", "n"],
                    )

    parts = sample.select("__lang", utf8("__text").alias("__utf8")).mapInArrow(run, "order int, entry string, lang string, n bigint")
    code = F.when(F.length("entry") <= longest_entry, F.xxhash64("entry"))
    return parts.groupBy("order", code.alias("hash"), "lang").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame,
    learns: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_each: int = 2_000,
    longest_entry: int = 40,
    most_cells: int = 4_000_000,
) -> Model | StoredModel:
    """Fit on a bounded sample of labelled rows: about docs_each of each language, chosen by a hash of the id.

    Every language that occurs is learned, with all its words and n-grams. Words of more than
    longest_entry characters are always known by their n-grams. Entries are identified by 64-bit
    hashes. A model of at most most_cells (entry, language) pairs, 24 bytes each or less, is
    collected and will be broadcast; a larger one stays a table, which texts meet by joins, with
    the same results. Null texts and languages teach nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & learns).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    rates = {r["__lang"]: min(1.0, docs_each / r["count"]) for r in labelled.groupBy("__lang").count().collect()}
    if not rates:
        return Model([], {}, {})
    languages = sorted(rates)
    known = F.broadcast(spark.createDataFrame([(lang, i, rates[lang]) for i, lang in enumerate(languages)], "lang string, i int, rate double"))  # a row for each language
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("language"), F.col("__id")), 11).cast("double") / F.lit(float(2**53))
    sample = labelled.join(known, F.col("__lang") == F.col("lang")).where(draw < F.col("rate")).select("__lang", "__text")
    scratch = Scratch(spark, "language")
    counted = scratch.write(_counted(sample, longest_entry), "counts")
    cells = counted.where("hash IS NOT NULL").join(known, "lang").select("order", "hash", F.struct("i", F.log(2.0 * F.col("n") + 1.0).alias("gain")).alias("cell"))
    entries, (size,) = scratch.write_measured(cells.groupBy("order", "hash").agg(F.sort_array(F.collect_list("cell")).alias("cells")), "entries", F.sum(F.size("cells")))
    sizes = {r["order"]: r["count"] for r in entries.groupBy("order").count().collect()}
    place, totals = {lang: i for i, lang in enumerate(languages)}, np.zeros((_LONGEST + 1, len(languages)))
    for r in counted.groupBy("order", "lang").agg(F.sum("n").alias("n")).collect():
        totals[r["order"], place[r["lang"]]] = r["n"]
    floors = {order: np.log(0.5 / (totals[order] + 0.5 * (sizes.get(order, 0) + 1))) for order in range(_LONGEST + 1)}
    if (size or 0) > most_cells:
        scratch.drop("counts")
        return StoredModel(languages, entries, floors, scratch)
    rows = entries.select("order", "hash", F.col("cells.i").alias("i"), F.col("cells.gain").cast("array<float>").alias("gain")).toArrow().combine_chunks()
    scratch.drop()
    return Model(languages, {order: _packed(rows.filter(pc.equal(rows["order"], order)).sort_by("hash").combine_chunks()) for order in sizes}, floors)


def _packed(rows: pa.Table) -> Entries:
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(rows["i"]).to_numpy())]).astype(np.int64)
    which, gains = (pc.list_flatten(rows[c]).to_numpy() for c in ("i", "gain"))
    return Entries(rows["hash"].to_numpy(), starts, which, gains)


def identify(df: DataFrame, model: Model | StoredModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: the language of the whole text and its posterior probability.

    `und` with score 0 for a null text and one without a letter, and where nothing was learned.
    Only the text is an input; texts of any length are read whole; of languages that tie the
    first by name is taken. Ids may be null or repeat; every row gives one row, repeated rows
    equal ones, and further columns are left out. An empty table gives an empty result; id_col must
    not be named like an output.
    """
    no_clash(id_col, "lang_pred", "score")
    ship(df.sparkSession)
    if isinstance(model, StoredModel):
        return _identify_by_joins(df, model, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = []
            for cell in batch.column(1):
                found.append(scorer.predict(cell.as_py().decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), utf8(text_col).alias("__utf8")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def _grams(word: str, order: int) -> Column:
    """grams_of as a column; the word alone for order 0."""
    if not order:
        return F.array(F.col(word))
    marked = F.concat(F.lit("<"), F.col(word), F.lit(">")) if order > 1 else F.col(word)
    last = F.length(marked) - F.lit(order - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(marked, i, F.lit(order)))).otherwise(F.array().cast("array<string>"))


def _identify_by_joins(df: DataFrame, model: StoredModel, id_col: str, text_col: str) -> DataFrame:
    """identify, with the model as a table: distinct words are resolved once, then summed for each text.

    Order after order, the words that are still unknown meet the entries of that order. Words
    with over 1/4,096 of all (text, word) rows, so 4,096 at most, are spread over several keys.
    """
    spark, scratch, kind = df.sparkSession, Scratch(df.sparkSession, "language-texts"), df.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [_counted_words(cell.as_py().decode("utf-8", "replace")) for cell in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(c) for c in counted], pa.list_(pa.string())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))],
                names=["id", "row", "words", "times"],
            )

    texts = scratch.write(df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), utf8(text_col).alias("text")).mapInArrow(split, f"id {kind}, row bigint, words array<string>, times array<bigint>"), "texts")
    met = texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    unknown, (rows,) = scratch.write_measured(met.groupBy("word").agg(F.count(F.lit(1)).alias("texts")), "words", F.sum("texts"))
    heavy = F.broadcast(unknown.where(F.col("texts") > (rows or 0) / 4096.0).select("word", F.greatest(F.lit(1), F.ceil(F.col("texts") * (512.0 / max(1, rows or 0)))).cast("int").alias("spread")))
    resolved = None
    for order in _ORDERS:
        asked = unknown.select("word", F.explode(_grams("word", order)).alias("gram")).select("word", F.xxhash64("gram").alias("hash"))
        found = scratch.write(asked.join(model.entries.where(F.col("order") == order).select("hash", "cells"), "hash").select("word", "cells"), f"found{order}")
        known = found.groupBy("word").agg(F.count(F.lit(1)).alias("known"))
        sums = found.select("word", F.inline("cells")).groupBy("word", "i").agg(F.sum("gain").alias("gain"))
        cells = sums.join(known, "word").groupBy("word").agg(F.collect_list(F.struct("i", (F.col("gain") / F.col("known")).alias("gain"))).alias("cells"))
        # A word takes its order's floors once: counted as languages below zero.
        own = cells.select("word", F.concat("cells", F.array(F.struct(F.lit(-1 - order).alias("i"), F.lit(1.0).alias("gain")))).alias("cells"))
        resolved = own if resolved is None else resolved.unionByName(own)
        unknown = scratch.write(unknown.select("word").join(known, "word", "left_anti"), f"unknown{order}")
    spread = F.coalesce("spread", F.lit(1))
    copies = resolved.join(heavy, "word", "left").select("word", "cells", F.explode(F.sequence(F.lit(0), spread - 1)).alias("part"))
    dealt = met.join(heavy, "word", "left").select("row", "word", "n", F.pmod(F.xxhash64("row"), spread).cast("int").alias("part"))
    gained = dealt.join(copies, ["word", "part"]).select("row", "n", F.inline("cells")).groupBy("row", "i").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    by_row = gained.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "gain"))).alias("sums"))  # a language each at most
    shared = spark.sparkContext.broadcast((model.languages, np.array(model.floors)))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, floors = shared.value
        for batch in batches:
            found = []
            for worded, which, gains in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                total = np.zeros(len(languages))
                for i, gain in zip(which or [], gains or [], strict=True):
                    if i < 0:
                        total += gain * floors[-1 - i]
                    else:
                        total[i] += gain
                found.append(_decided(languages, total) if worded else ("und", 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    joined = texts.join(by_row, "row", "left").select("id", F.size("words") > 0, "sums.i", "sums.gain")
    return joined.mapInArrow(decide, f"`{id_col}` {kind}, lang_pred string, score double")
