"""Language-model scores of order three against brute force, at several ways of cutting the work."""

from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import lm
from loomgraph.llm.common import Scratch

START = "start"


def chains(n, rng):
    texts = []
    for length in rng.integers(0, 80, n):
        k, out = int(rng.integers(40)), []
        for _ in range(length):
            out.append(f"w{k}")
            k = (3 * k + len(out) % 2) % 40 if rng.random() < 0.75 else int(rng.zipf(1.6)) % 40
        texts.append(" ".join(out))
    return [*texts, texts[0], texts[1], None, ""]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)


def part_of(i):
    return 0 if i % 7 == 2 else 2 if i % 5 == 0 else 1


def part():
    return F.when(F.col("doc_id") % 7 == 2, 0).when(F.col("doc_id") % 5 == 0, 2).otherwise(1)


def brute_force(texts):
    """score by doc, with weights learned from the events themselves, not from cells."""
    seq = [[*(t or "").split(), None] for t in texts]
    grams = [[((START, START, w) if k == 0 else (START if k == 1 else s[k - 2], s[k - 1], w)) for k, w in enumerate(s)] for s in seq]
    count = {n: {1: Counter(), 2: Counter()} for n in (1, 2, 3)}
    held = {2: Counter(), 3: Counter()}
    for i, g in enumerate(grams):
        for n in (1, 2, 3):
            tails = [x[3 - n :] for x in g]
            if part_of(i):
                count[n][1].update(tails)
            if part_of(i) == 1:
                count[n][2].update(tails)
            if part_of(i) == 2 and n > 1:
                held[n].update(tails)

    def tables(which):
        one, two, three = (count[n][which] for n in (1, 2, 3))
        ends = one[(None,)]
        before2 = lambda a: ends if a == START else one[(a,)]
        before3 = lambda a, b: ends if b == START else two[(a, b)]
        return one, two, three, before2, before3

    v = len(count[1][1])
    uniform = 1 / (v + 1)

    def p2(a, w, which, weights):
        one, two, _, before2, _ = tables(which)
        c = before2(a)
        l = weights[int(lm.bucket(np.array([c]))[0])]
        return l[0] * (two[a, w] / c if c else 0) + l[1] * one[(w,)] / sum(one.values()) + l[2] * uniform

    one, two, three, before2, before3 = tables(2)
    n_ret = sum(one.values())
    cells = []
    for (a, w), k in held[2].items():
        c = before2(a)
        cells.append((int(lm.bucket(np.array([c]))[0]), k, two[a, w] / c if c else 0.0, one[(w,)] / n_ret))
    weights = lm.learn_weights(np.array(sorted(cells), float), uniform)
    cells = []
    for (a, b, w), k in held[3].items():
        c, whole = before3(a, b), tables(1)[4](a, b)
        cells.append((int(lm.bucket(np.array([whole]))[0]), k, three[a, b, w] / c if c else 0.0, p2(b, w, 2, weights)))
    mix = lm.learn_mix(np.array(sorted(cells), float))
    _, _, three, _, before3 = tables(1)
    scores = []
    for g in grams:
        total = 0.0
        for a, b, w in g:
            c = before3(a, b)
            m = mix[int(lm.bucket(np.array([c]))[0])]
            total += log10(m * (three[a, b, w] / c if c else 0) + (1 - m) * p2(b, w, 1, weights))
        scores.append(total)
    return scores, [len(s) for s in seq]


@pytest.mark.parametrize("at_once, piece", [(4096, 1 << 20), (2, 7)])
def test_order_three_against_brute_force(spark, monkeypatch, at_once, piece):
    texts = chains(120, np.random.default_rng(3))
    expected, sizes = brute_force(texts)
    monkeypatch.setattr(lm, "_PIECE_WORDS", piece)
    out = {r["doc_id"]: r for r in lm.score_texts(frame(spark, texts), part(), chunk_bytes=900, order=3, chunks_at_once=at_once).collect()}
    assert [out[i]["n_tokens"] for i in range(len(texts))] == sizes
    assert max(abs(out[i]["score"] - e) / n for i, (e, n) in enumerate(zip(expected, sizes, strict=True))) < 2e-3  # events of nearly equal ratios share a cell
    assert out[len(texts) - 2]["score"] == pytest.approx(out[len(texts) - 1]["score"])  # null as empty


def decoded(spark, texts, piece):
    """Probabilities' inputs of a text encoded in pieces: the n-grams of all its chunks."""
    row = {"chunk": 0, "ids": [], "rows": [], "sizes": [], "firsts": [], "seconds": [], "lasts": [], "parts": [], "words": [], "vocabulary": []}
    numbers: dict[str, int] = {}
    for i, t in enumerate(texts):
        words = t.split()
        for at in range(0, max(1, len(words)), piece):
            look = lambda w: numbers.setdefault(w, len(numbers))
            some = words[at : at + piece]
            row["words"] += [look(w) for w in some]
            for name, value in (("ids", i), ("rows", i), ("sizes", len(some)), ("firsts", look(words[at - 1]) if at else -1), ("seconds", look(words[at - 2]) if at > 1 else -1), ("lasts", at + piece >= len(words)), ("parts", 1)):
                row[name].append(value)
    kinds = {"rows": "<i8", "sizes": "<i4", "firsts": "<i4", "seconds": "<i4", "lasts": "u1", "parts": "u1"}
    from xxhash import xxh64_intdigest

    row |= {n: np.array(row[n], k).tobytes() for n, k in kinds.items()}
    row["words"] = lm._planes(np.array(row["words"], np.int64))
    row["vocabulary"] = np.array([xxh64_intdigest(w.encode()) for w in numbers], "<u8").tobytes()
    return lm.Chunk(row)


def test_pieces_have_the_same_ngrams_as_whole_texts(spark):
    texts = ["a b c a b d e f g h " * 30, "b c a", "a b", "", "x " * 25]
    whole = decoded(spark, texts, 1 << 20)
    for piece in (1, 2, 3, 7, 100):
        cut = decoded(spark, texts, piece)
        for order in (1, 2, 3):
            mine, theirs = ({int(h): int(r) for h, r, _ in zip(*c.grams(order), strict=True) if r} for c in (cut, whole))
            assert mine == theirs
        assert cut.events.sum() == whole.events.sum()


def test_rows_grow_with_the_input_and_no_faster(spark):
    rng = np.random.default_rng(5)
    sizes = []
    for n in (60, 240):
        texts = [" ".join(f"v{int(k)}" for k in rng.integers(0, 3000, 60)) for _ in range(n)]
        scratch = Scratch(spark, "rows")
        chunks = scratch.write(lm.encode(frame(spark, texts).coalesce(1), F.lit(1), "doc_id", "text", 2000), "chunks")
        questions = chunks.mapInArrow(lm._questions((1, 2, 3), 8, 4), lm._QUESTION)
        sizes.append((chunks.count(), questions.count()))
    assert sizes[1][0] > 3 * sizes[0][0]
    assert sizes[1][1] <= 1.1 * sizes[0][1] * sizes[1][0] / sizes[0][0]


def test_repeated_documents_score_above_others(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"v{int(k)}" for k in rng.integers(0, 400, 60)) for _ in range(300)]
    texts += texts[:60]
    out = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score_texts(frame(spark, texts), F.when(F.col("doc_id") % 11 == 0, 2).otherwise(1), order=3).collect()}
    twice, once = [out[i] for i in range(60)], [out[i] for i in range(60, 300)]
    assert np.quantile(twice, 0.1) > np.quantile(once, 0.9)


def test_empty_table_and_nothing_to_learn_from(spark):
    assert lm.score_texts(frame(spark, ["a"]).where("false"), F.lit(1), order=3).count() == 0
    out = lm.score_texts(frame(spark, ["a b", None]), F.lit(0), order=3).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in out)
