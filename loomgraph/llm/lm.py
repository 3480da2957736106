"""Language-model scores by deleted interpolation.

P2(w | v) = l2(b) c(v w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), b being the bucket of the
context's frequency c(v), and P3(w | u v) = m(b) c(u v w) / c(u v) + (1 - m(b)) P2(w | v), b
being that of c(u v). The weights of each bucket are learned by expectation-maximisation on
counts that were held out (deleted) while the ratios were taken, those of P2 first. m's bucket
is that of c(u v) with nothing deleted: a pair that stands once in all says nothing of what
follows it, and one that stands twice says what the deleted counts show of such pairs.

The model is as large as the corpus, so it is never broadcast. Texts are first encoded into
chunks, each a row of word numbers with the chunk's own vocabulary. Every chunk asks for its
distinct n-grams (as sorted 64-bit hashes, cut into `shards` ranges of the hash) once; a range
sums what came from a group of chunks, sums of groups meet by hash, and each chunk gets its
n-grams' totals in the order it asked for them. Rows are thus `shards` for each chunk, a
constant, and one for each distinct n-gram of a group of chunks where there are several
groups: both in proportion to the input. No text is shuffled for counting.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, parts_for, release_memory, ship, utf8

_END, _BUCKETS = np.uint64(0x7E57ED0E0F0D0C0B), 28
_PIECE_WORDS = 1 << 20  # longer texts are several pieces, so that no chunk follows a text's length
_LEAST_UNIFORM = 1e-5


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers, their bytes grouped by significance and compressed: high ones are nearly all zero."""
    from zstandard import ZstdCompressor

    width = 4 if not len(values) or values.max() < 1 << 32 else 8
    planes = np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + ZstdCompressor(level=1).compress(planes.tobytes())


def _from_planes(raw: bytes) -> np.ndarray:
    from zstandard import ZstdDecompressor

    planes = np.frombuffer(ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel().astype(np.int64)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash of two words' hashes, order mattering."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def encode(df: DataFrame, part: Column, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Chunks of texts as word numbers. part: 0 not learned from, 1 retained, 2 held out for the weights.

    Held-out texts have chunks of their own, whose numbers are odd: only these are read while the
    weights are learned.
    """
    from xxhash import xxh64_intdigest  # noqa: F401 - fails here rather than in a task

    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["chunk", "ids", "rows", "sizes", "firsts", "seconds", "lasts", "parts", "words", "vocabulary"]
    schema = f"chunk bigint, ids array<{kind}>, rows binary, sizes binary, firsts binary, seconds binary, lasts binary, parts binary, words binary, vocabulary binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        task, chunks, texts = TaskContext.get().partitionId() << 32, count(), count()
        def begin() -> dict:
            return {"numbers": defaultdict(count().__next__), "bytes": 0, **{n: [] for n in ("ids", "rows", "sizes", "firsts", "seconds", "lasts", "parts", "words")}}

        def finish(held: int) -> pa.RecordBatch:
            state = states[held]
            vocabulary = np.fromiter(map(xxh64_intdigest, state["numbers"]), np.uint64, len(state["numbers"]))
            words = np.concatenate([np.zeros(0, np.int32), *state["words"]])
            # The most frequent words get the smallest numbers, so that these compress well.
            often = np.argsort(-np.bincount(words, minlength=len(vocabulary)), kind="stable")
            rank = np.empty(len(vocabulary) + 1, np.int64)
            rank[often], rank[-1] = np.arange(len(vocabulary)), -1
            for name in ("firsts", "seconds"):
                state[name] = rank[np.array(state[name], np.int64)]
            arrays = [np.array(state[n], t).tobytes() for n, t in (("rows", "<i8"), ("sizes", "<i4"), ("firsts", "<i4"), ("seconds", "<i4"), ("lasts", "u1"), ("parts", "u1"))]
            words, vocabulary = _planes(rank[words]), vocabulary[often]
            ids = pa.array([state["ids"]], pa.list_(id_type))
            return pa.RecordBatch.from_arrays([pa.array([2 * (task + next(chunks)) + held]), ids, *(pa.array([b], pa.binary()) for b in (*arrays, words, vocabulary.tobytes()))], names=names)

        states, id_type = [begin(), begin()], None
        for batch in batches:
            id_type = batch.column(0).type
            for key, p, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens, row = cell.as_py().lower().split(), task + next(texts)
                held = int(p == 2)
                state = states[held]
                for at in range(0, max(1, len(tokens)), _PIECE_WORDS):
                    piece = tokens[at : at + _PIECE_WORDS]
                    look = state["numbers"].__getitem__
                    state["words"].append(np.fromiter(map(look, piece), np.int32, len(piece)))
                    for name, value in (("ids", key), ("rows", row), ("sizes", len(piece)), ("firsts", look(tokens[at - 1]) if at else -1), ("seconds", look(tokens[at - 2]) if at > 1 else -1), ("lasts", at + _PIECE_WORDS >= len(tokens)), ("parts", p)):
                        state[name].append(value)
                    state["bytes"] += sum(map(len, piece)) + len(piece) + 1
                    if state["bytes"] >= chunk_bytes:
                        yield finish(held)
                        state = states[held] = begin()
        for held in (0, 1):
            if states[held]["ids"]:
                yield finish(held)

    return df.select(F.col(id_col), part.cast("int").alias("__part"), utf8(text_col).alias("__utf8")).mapInArrow(run, schema)


class Chunk:
    """A decoded chunk: for each event (a word or an end) its word, the one before it, its part; n-grams up to three."""

    def __init__(self, row: dict):
        def read(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(row[name], kind)

        self.id, self.ids, self.rows = row["chunk"], row["ids"], read("rows", "<i8")
        vocabulary, sizes, lasts = read("vocabulary", "<u8"), read("sizes", "<i4").astype(np.int64), read("lasts", "u1").astype(np.int64)
        self.end = len(vocabulary)  # the number of the end; one more is that of the start
        self.width = self.end + 2
        self.hashes = np.append(vocabulary, _END)
        self.events = sizes + lasts
        self.begins = np.cumsum(self.events) - self.events
        self.word = np.full(int(self.events.sum()), self.end, np.int32)
        words = _from_planes(row["words"])
        if len(words):
            before = np.cumsum(sizes) - sizes
            self.word[np.arange(len(words)) + np.repeat(self.begins - before, sizes)] = words
        first, second = read("firsts", "<i4").astype(np.int64), read("seconds", "<i4").astype(np.int64)
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.begins] = np.where(first < 0, self.end + 1, first)
        self.part = np.repeat(read("parts", "u1"), self.events)
        codes = self.context.astype(np.int64) * self.width + self.word
        # The pair before a piece that goes on with a text is asked for too, though it isn't counted here.
        piece = first >= 0
        ahead = np.where(second < 0, self.end + 1, second)[piece] * self.width + first[piece]
        self.codes, place, self.retained, self.held = _distinct(np.append(codes, ahead), np.append(self.part, np.zeros(len(ahead), np.uint8)))
        self.pair = place[: len(codes)]
        #: The place of the pair before each event among the distinct ones; one more at a text's start.
        self.before = np.empty_like(self.pair)
        self.before[1:] = self.pair[:-1]
        starts = np.full(len(first), len(self.codes), np.int32)
        starts[piece] = place[len(codes) :]
        self.before[self.begins] = starts

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each word of the vocabulary, and the end, stands in retained and in held-out texts."""
        return tuple(np.bincount(self.word[self.part == k], minlength=self.end + 1) for k in (1, 2))

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Context and word of the distinct pairs."""
        return self.codes // self.width, self.codes % self.width

    @cached_property
    def pair_hashes(self) -> np.ndarray:
        context, word = self.split()
        return _pair_hash(np.append(self.hashes, ~_END)[context], self.hashes[word])

    @cached_property
    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct triples: place of the pair in front, word, hash, retained and held-out counts; the triple of each event."""
        codes, place, retained, held = _distinct(self.before.astype(np.int64) * self.width + self.word, self.part)
        before, word = codes // self.width, codes % self.width
        return before, word, _pair_hash(np.append(self.pair_hashes, ~_END)[before], self.hashes[word]), retained, held, place

    def frequency(self, single: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The counts of the contexts of the distinct triples."""
        return np.append(pair, single[self.end])[self.triples[0]]

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, retained and held-out counts of the distinct n-grams of an order."""
        if order == 1:
            return (self.hashes, *self.singles())
        if order == 2:
            return self.pair_hashes, self.retained, self.held
        return self.triples[2:5]


def _distinct(codes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in order, the place of each code among them, and how often they stand in parts 1 and 2."""
    if not len(codes):
        return codes, codes, codes, codes
    bits = int(len(codes)).bit_length()
    if int(codes.max()).bit_length() + bits > 63:
        order = np.argsort(codes, kind="stable")
        code = codes[order]
    else:  # sorting in place takes less memory than an index
        code = codes << bits
        code |= np.arange(len(codes))
        code.sort()
        order = (code & ((1 << bits) - 1)).astype(np.int32)
        code >>= bits
    new = np.append(True, code[1:] != code[:-1])
    place = np.empty(len(codes), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    code = code[new]
    return code, place, *(np.bincount(place[part == k], minlength=len(code)).astype(np.int32) for k in (1, 2))


_QUESTION = "grp int, gram int, shard int, chunk bigint, hashes binary, retained binary, held binary"
_ANSWER = "gram int, shard int, chunk bigint, total binary, held binary"


def _cuts(ordered: np.ndarray, n_shards: int) -> np.ndarray:
    """Where each of n_shards equal ranges of the hash begins among sorted hashes, and their end."""
    edges = (np.arange(1, n_shards, dtype=np.uint64) * np.uint64(2**64 // n_shards)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(ordered, edges), [len(ordered)]])


def _hash_planes(hashes: np.ndarray) -> bytes:
    """Sorted hashes, their bytes grouped by significance: the high ones hardly change and compress away."""
    from zstandard import ZstdCompressor

    planes = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8).T
    return ZstdCompressor(level=1).compress(planes.tobytes())


def _hashes_from(raw: bytes) -> np.ndarray:
    from zstandard import ZstdDecompressor

    planes = np.frombuffer(ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64)


def _questions(orders: tuple[int, ...], n_shards: int, n_groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one chunk at a time in memory
                chunk = Chunk(batch.slice(i, 1).to_pylist()[0])
                group = (chunk.id * 0x9E3779B97F4A7C15 >> 20) % n_groups
                for order in orders:
                    hashes, retained, held = chunk.grams(order)
                    by_hash = np.argsort(hashes)
                    hashes, retained, held = hashes[by_hash], retained[by_hash], held[by_hash]
                    at = _cuts(hashes, n_shards)
                    used = np.flatnonzero(at[1:] > at[:-1])
                    spans = [(at[k], at[k + 1]) for k in used]
                    columns = [pa.array([f(x[a:b]) for a, b in spans], pa.binary()) for f, x in ((_hash_planes, hashes), (_planes, retained), (_planes, held))]
                    n = len(used)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([group] * n, pa.int32()), pa.array([order] * n, pa.int32()), pa.array(used, pa.int32()), pa.array([chunk.id] * n, pa.int64()), *columns],
                        names=["grp", "gram", "shard", "chunk", "hashes", "retained", "held"],
                    )
                del chunk
                release_memory()

    return run


def _asked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Distinct hashes of the questions, their sums, each question's places among them, and (chunk, size) of each."""
    lists = [_hashes_from(r["hashes"]) for r in rows]
    distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
    retained, held = (np.bincount(place, np.concatenate([_from_planes(r[n]) for r in rows]), len(distinct)).astype(np.int64) for n in ("retained", "held"))
    return distinct, retained, held, place, [(r["chunk"], len(x)) for r, x in zip(rows, lists, strict=True)]


def _replies(gram: int, shard: int, total: np.ndarray, retained: np.ndarray, place: np.ndarray, asked: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """A row for each question: the totals of its n-grams in the order it named them."""
    at = 0
    for i in range(0, len(asked), 64):
        some, replies = asked[i : i + 64], ([], [])
        for _, size in some:
            own = place[at : at + size]
            at += size
            replies[0].append(_planes(total[own]))
            replies[1].append(_planes(total[own] - retained[own]))  # nearly all zero
        columns = [pa.array([gram] * len(some), pa.int32()), pa.array([shard] * len(some), pa.int32()), pa.array([c for c, _ in some], pa.int64()), *(pa.array(r, pa.binary()) for r in replies)]
        yield pa.RecordBatch.from_arrays(columns, names=["gram", "shard", "chunk", "total", "held"])


def _answers(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One group of chunks is all: its sums are the totals. A row of chunk -1 has the range's own sums of words."""
    gram, shard = key[1].as_py(), key[2].as_py()
    _, retained, held, place, asked = _asked([r for b in batches for r in b.to_pylist()])
    release_memory()
    total = retained + held
    yield from _replies(gram, shard, total, retained, place, asked)
    if gram == 1:
        sums = np.array([total.sum(), retained.sum(), (total > 0).sum()], "<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([shard], pa.int32()), pa.array([-1], pa.int64()), pa.array([sums], pa.binary()), pa.array([b""], pa.binary())], names=["gram", "shard", "chunk", "total", "held"])


def _group_sums(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct n-gram of a group's range."""
    distinct, retained, held, _, _ = _asked([r for b in batches for r in b.to_pylist()])
    n = len(distinct)
    columns = [*(pa.array([k.as_py()] * n, pa.int32()) for k in key), pa.array(distinct.view(np.int64)), pa.array(retained), pa.array(held)]
    yield pa.RecordBatch.from_arrays(columns, names=["grp", "gram", "shard", "hash", "retained", "held"])


def _reply_from_sums(key: tuple[pa.Scalar, ...], questions: pa.Table, sums: pa.Table) -> pa.Table:
    distinct, _, _, place, asked = _asked(questions.to_pylist())
    hashes = sums["hash"].to_numpy().view(np.uint64)
    by_hash = np.argsort(hashes)  # the same distinct ones, in order
    replies = _replies(key[1].as_py(), key[2].as_py(), sums["total"].to_numpy()[by_hash], sums["retained"].to_numpy()[by_hash], place, asked)
    return pa.Table.from_batches(list(replies))


def ask(scratch: Scratch, chunks: DataFrame, orders: tuple[int, ...], n_shards: int, n_groups: int) -> tuple[DataFrame, np.ndarray]:
    """(gram, shard, chunk, total, held): each chunk's counts of all its n-grams; and words in training texts, those retained, distinct ones."""
    name = "-".join(map(str, orders))
    questions = chunks.mapInArrow(_questions(orders, n_shards, n_groups), _QUESTION)
    if n_groups == 1:
        answers = scratch.write(questions.groupBy("grp", "gram", "shard").applyInArrow(_answers, _ANSWER), f"answers-{name}", drop_shuffles=True)
        sums = np.zeros(3, np.int64)
        for row in answers.where("chunk = -1").select("total").collect():
            sums += np.frombuffer(row["total"], "<i8")
        return answers.where("chunk >= 0"), sums
    parts = scratch.write(questions.groupBy("grp", "gram", "shard").applyInArrow(_group_sums, "grp int, gram int, shard int, hash bigint, retained bigint, held bigint"), f"parts-{name}", drop_shuffles=True)
    whole = parts.groupBy("gram", "hash").agg(F.sum(F.col("retained") + F.col("held")).alias("total"), F.sum("retained").alias("retained"))
    whole = scratch.write(whole, f"whole-{name}", drop_shuffles=True)
    known = parts.select("grp", "gram", "shard", "hash").join(whole, ["gram", "hash"])
    keys = ["grp", "gram", "shard"]
    answers = questions.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(_reply_from_sums, _ANSWER)
    answers = scratch.write(answers, f"answers-{name}", drop_shuffles=True)
    row = whole.where("gram = 1").agg(*[F.coalesce(x, F.lit(0)).cast("long") for x in (F.sum("total"), F.sum("retained"), F.count_if(F.col("total") > 0))]).first()
    return answers, np.array(row, np.int64)


def _collected(hashes: np.ndarray, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Total and retained counts in the order of `hashes`: ranges in order are the sorted hashes."""
    by_hash, rows = np.argsort(hashes), sorted(answers, key=lambda r: r["shard"])
    at = _cuts(hashes[by_hash], answers[0]["__shards"]) if rows else np.zeros(1, np.int64)
    out = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    for row in rows:
        own = by_hash[at[row["shard"]] : at[row["shard"] + 1]]
        out[0][own] = _from_planes(row["total"])
        out[1][own] = out[0][own] - _from_planes(row["held"])
    return out


def _answered(chunk: Chunk, answers: pa.Table, n_shards: int, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(total, retained) of the chunk's n-grams, by order."""
    rows: dict[int, list[dict]] = {}
    for row in answers.to_pylist():
        rows.setdefault(row["gram"], []).append({**row, "__shards": n_shards})
    return {k: _collected(chunk.grams(k)[0], rows.get(k, [])) for k in range(1, order + 1)}


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(its count)), up to a last bucket."""
    return np.where(context > 0, np.minimum(np.frexp(np.maximum(context, 1))[1], _BUCKETS - 1), 0)


def _ratio(part: np.ndarray, whole: np.ndarray | float) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=np.asarray(whole) > 0)


def learn_weights(cells: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """EM for each bucket's three weights. cells: rows (bucket, events, pair ratio, word ratio)."""
    weights = np.full((_BUCKETS, 3), np.nan)
    for b in range(_BUCKETS):
        own = cells[cells[:, 0] == b]
        if len(own):
            p, n = np.column_stack([own[:, 2], own[:, 3], np.full(len(own), uniform)]), own[:, 1]
            w = np.full(3, 1 / 3) if b else np.array([0.0, 0.5, 0.5])
            for _ in range(rounds):
                share = p * w
                share /= share.sum(axis=1, keepdims=True)
                w = n @ share / n.sum()
            weights[b] = w
    if np.isnan(weights[0, 0]):
        weights[0] = (0.0, 0.5, 0.5)
    for b in range(1, _BUCKETS):  # buckets without held-out events do as the one below
        if np.isnan(weights[b, 0]):
            weights[b] = weights[b - 1] if b > 1 else 1 / 3
    weights[0, 0] = 0.0
    weights[:, 2] = np.maximum(weights[:, 2], _LEAST_UNIFORM)
    return weights / weights.sum(axis=1, keepdims=True)


def learn_mix(cells: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM for each bucket's weight of the longer ratio. cells: rows (bucket, events, ratio, probability without it)."""
    weight = np.full(_BUCKETS, np.nan)
    for b in range(1, _BUCKETS):
        own = cells[cells[:, 0] == b]
        if len(own):
            n, ratio, rest = own[:, 1], own[:, 2], own[:, 3]
            m = 0.5
            for _ in range(rounds):
                m = float(n @ (m * ratio / (m * ratio + (1 - m) * rest))) / n.sum()
            weight[b] = min(m, 1 - _LEAST_UNIFORM)
    weight[0] = 0.0
    for b in range(1, _BUCKETS):  # buckets without held-out events do as the one below
        if np.isnan(weight[b]):
            weight[b] = weight[b - 1]
    return weight


def _level(p: np.ndarray) -> np.ndarray:
    """Ratios as quarter powers of two; 0 for none."""
    return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-18)) * 4) + 256, 0).astype(np.int64)


class Mixture:
    """The probabilities of a chunk's n-grams from counts, once the weights are known."""

    def __init__(self, weights: np.ndarray, uniform: float, n_words: int, mix: np.ndarray | None = None):
        self.weights, self.uniform, self.n_words, self.mix = weights, uniform, n_words, mix

    def ratios(self, chunk: Chunk, single: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct pairs: the context's frequency, the pair's ratio, the word's ratio."""
        context, word = chunk.split()
        frequency = np.append(single, single[chunk.end])[context]
        return frequency, _ratio(pair, frequency), _ratio(single[word], float(self.n_words))

    def pairs(self, chunk: Chunk, single: np.ndarray, pair: np.ndarray) -> np.ndarray:
        frequency, p2, p1 = self.ratios(chunk, single, pair)
        w = self.weights[bucket(frequency)]
        return w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * self.uniform

    def triples(self, chunk: Chunk, single: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the distinct triples: the triple's ratio, the probability without it."""
        before, *_, place = chunk.triples
        of_pair = np.empty(len(before), np.int64)
        of_pair[place] = chunk.pair
        return _ratio(triple, chunk.frequency(single, pair)), self.pairs(chunk, single, pair)[of_pair]

    def events(self, chunk: Chunk, counts: dict[int, np.ndarray]) -> np.ndarray:
        """The probability of each event."""
        if self.mix is None:
            return self.pairs(chunk, counts[1], counts[2])[chunk.pair]
        ratio, rest = self.triples(chunk, counts[1], counts[2], counts[3])
        m = self.mix[bucket(chunk.frequency(counts[1], counts[2]))]
        return (m * ratio + (1 - m) * rest)[chunk.triples[-1]]


def score_texts(
    df: DataFrame,
    part: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 4_000_000,
    order: int = 2,
    chunks_at_once: int = 4096,
    most_shards: int = 1024,
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row.

    part: 0 for rows not learned from, 1 for rows whose counts make the ratios, 2 for training
    rows held out while the weights are learned; the model then counts both. Scores are log10
    probabilities of the whole text, its end included, by P2 or P3 (order 2 or 3); base_score
    is that of add-one unigrams. Null and empty texts are one end. Without training rows, all
    words are equally likely. Texts of any length are scored whole, in pieces that know the
    words before them. Ids may repeat or be null; every row gives one row, repeated rows equal
    ones, and further columns are left out.

    A task holds a chunk of texts, or of chunks_at_once chunks the n-grams of one of at most
    most_shards ranges of the hash; both bound its memory at every size of the input.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "lm")
    n_shards = min(most_shards, parts_for(df, 4_000_000))
    chunks = scratch.write(encode(df, part, id_col, text_col, chunk_bytes), "chunks")
    n_groups = max(1, -(-chunks.count() // chunks_at_once))
    answers, sums = ask(scratch, chunks, (1, 2), n_shards, n_groups)
    if order == 3:
        answers = answers.unionByName(ask(scratch, chunks, (3,), n_shards, n_groups)[0])
    n_total, n_retained, n_words = (int(x) for x in sums)
    uniform = 1.0 / (n_words + 1)

    def both(most: int, wanted: Column):
        return chunks.where(wanted).groupBy("chunk").cogroup(answers.where((F.col("gram") <= most) & wanted).groupBy("chunk"))

    def seen(name: str, most: int, take) -> np.ndarray:
        """(bucket, events, ratio, other) of held-out events. Those of nearly equal ratios are one cell, so what is collected is bounded by the cells' number."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            cells: dict[str, list] = {"cell": [], "n": [], "x": [], "y": []}
            for row in left.to_pylist():
                chunk = Chunk(row)
                both_counts = _answered(chunk, right, n_shards, most)
                held, frequency, x, y = take(chunk, *({k: v[i] for k, v in both_counts.items()} for i in (0, 1)))
                used = held > 0
                n, frequency, x, y = held[used].astype(float), frequency[used], x[used], y[used]
                cell, place = np.unique((bucket(frequency) * 512 + _level(x)) * 512 + _level(y), return_inverse=True)
                for key, values in (("cell", cell), ("n", np.bincount(place, n, len(cell))), ("x", np.bincount(place, n * x, len(cell))), ("y", np.bincount(place, n * y, len(cell)))):
                    cells[key].extend(values.tolist())
            return pa.table({"cell": pa.array(cells["cell"], pa.int64()), **{k: pa.array(cells[k], pa.float64()) for k in ("n", "x", "y")}})

        summed = both(most, F.col("chunk") % 2 == 1).applyInArrow(run, "cell bigint, n double, x double, y double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y")])
        rows = scratch.write(summed, name, drop_shuffles=True).collect()
        return np.array(sorted((r["cell"] >> 18, r["n"], r["x"] / r["n"], r["y"] / r["n"]) for r in rows), float).reshape(-1, 4)

    plain = Mixture(np.zeros((_BUCKETS, 3)), uniform, n_retained)
    weights = learn_weights(seen("cells-2", 2, lambda chunk, _, c: (chunk.held, *plain.ratios(chunk, c[1], c[2]))), uniform)
    if not n_total:
        weights[:] = (0.0, 0.0, 1.0)
    mix = None
    if order == 3:
        short = Mixture(weights, uniform, n_retained)
        mix = learn_mix(seen("cells-3", 3, lambda chunk, total, c: (chunk.triples[4], chunk.frequency(total[1], total[2]), *short.triples(chunk, c[1], c[2], c[3]))))
    model = Mixture(weights, uniform, n_total, mix)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        for row in left.to_pylist():
            chunk = Chunk(row)
            counts = {k: v[0] for k, v in _answered(chunk, right, n_shards, order).items()}
            single, begins = counts[1], chunk.begins
            base = np.log10((single + 1) / (n_total + n_words + 1))
            for values, column in zip(
                (chunk.rows, chunk.events, np.add.reduceat((single > 0)[chunk.word].astype(np.int64), begins), np.add.reduceat(base[chunk.word], begins), np.add.reduceat(np.log10(model.events(chunk, counts)), begins)),
                out[1:],
                strict=True,
            ):
                column.extend(values.tolist())
            out[0].extend(chunk.ids)
        release_memory()
        kinds = (id_type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[id_col, "__row", "n_tokens", "n_known", "base_score", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type, kind = to_arrow_type(df.schema[id_col].dataType), df.schema[id_col].dataType.simpleString()
    pieces = both(order, F.lit(True)).applyInArrow(score, f"`{id_col}` {kind}, __row bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    whole = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return pieces.groupBy("__row").agg(F.first(id_col).alias(id_col), *whole).select(id_col, "n_tokens", "n_known", F.lit(n_total).cast("long").alias("train_tokens"), "base_score", "score")
