"""The registered queries over small tables against brute force: remainders, columns, values of odd rows."""

import re
import zlib
from collections import Counter, defaultdict
from math import exp, log, log10

import numpy as np
import pytest
import xxhash

from loomgraph.llm import language, tokens
from loomgraph.llm.queries import QUERIES
from tests.llm.test_operators import components, edit_distance_anywhere, fingerprint, words
from loomgraph.llm.decontamination import normalise

N = 90


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(17)
    vocabulary = {"en": ["the", "house", "stands", "near", "a", "river", "and", "hills"], "de": ["das", "Haus", "steht", "nahe", "dem", "Fluß", "und", "Hügel"]}
    items = ["alpha beta gamma delta epsilon zeta eta theta iota kappa", "cat", "!!"]
    rows = []
    for i in range(N):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(vocabulary[lang], int(rng.integers(5, 60))))
        if i % 9 == 0 and i:
            text = rows[i - 1][1]
        if i % 13 == 5:
            text = text + "\n" + items[0].upper() + "\n" + text.replace(" ", "  ")
        rows.append((i, text, lang if i % 7 else None, ["s", "t", None][i % 3], 0))
    odd = [None, "", " \n\t", "12 34 !?", "a concatenated cat", "the cat", "ÄÖÜ  Große\x0bStraße", "word " * 300, "x" * 70_000, "the cat"]
    rows += [(N + k, t, None if k % 2 else "en", None, 0) for k, t in enumerate(odd)]
    rows += [rows[3], (None, "the house near the river", "en", "s", 0), (None, "the house near the river", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(N)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def run(spark, tables, name):
    out = QUERIES[name](spark, tables[0])
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    return out.columns, rows, by


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n if i is not None else None


def same_rows(rows, by):
    assert Counter(k for k, v in by.items() for _ in v) == Counter(r[0] for r in rows)
    assert by[3][0] == by[3][1] and by[None][0] == by[None][1]


def test_op1(spark, tables):
    columns, _, by = run(spark, tables, "op1_language_id")
    rows = tables[1]
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    same_rows(rows, by)
    counts, totals = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    for i, text, lang, _, _ in rows:
        if text is None or lang is None or remainder(i, 3) == 1:
            continue
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for order in range(5):
                marked = f"<{w}>" if order > 1 else w
                for g in [w] if order == 0 else [marked[k : k + order] for k in range(len(marked) - order + 1)]:
                    totals[order][lang] += 1
                    if len(g) <= 40:
                        counts[order][g][lang] += 1
    langs = sorted({r[2] for r in rows if r[2]})

    def share(order, entry):
        size = len(counts[order])
        return np.array([log((counts[order][entry][x] + 0.5) / (totals[order][x] + 0.5 * (size + 1))) for x in langs])

    for i, text, _, _, _ in rows:
        r = by[i][0]
        assert r["held_out"] == (remainder(i, 3) == 1)
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not found:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = np.zeros(len(langs))
        for w in found:
            if w in counts[0]:
                total += share(0, w)
                continue
            for order in (4, 3, 2, 1):
                known = [g for g in language.grams_of(w, order) if g in counts[order]]
                if known:
                    total += np.mean([share(order, g) for g in known], axis=0)
                    break
        best = int(total.argmax())
        assert r["lang_pred"] == langs[best] and r["score"] == pytest.approx(1 / sum(exp(x - total[best]) for x in total), abs=1e-4)


def test_op2(spark, tables):
    columns, _, by = run(spark, tables, "op2_lm_scores")
    rows = tables[1]
    assert columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same_rows(rows, by)
    count = Counter()
    for i, text, *_ in rows:
        if remainder(i, 7) != 2:
            count.update([*words(text), None])
    n, v = sum(count.values()), len(count)
    for i, text, *_ in rows:
        r, seq = by[i][0], [*words(text), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(i, 7) == 2, len(seq), sum(count[w] > 0 for w in seq), n)
        assert r["base_score"] == pytest.approx(sum(log10((count[w] + 1) / (n + v + 1)) for w in seq))
        assert r["score"] < 0


def test_op3(spark, tables):
    _, _, by = run(spark, tables, "op3_token_counts")
    tokenizer = tokens.load_tokenizer("byte_bpe_50k.json")
    for i, text, *_ in tables[1]:
        r, n = by[i][0], len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 512)


def test_op4(spark, tables):
    _, _, by = run(spark, tables, "op4_simhash")
    rows = tables[1]
    same_rows(rows, by)
    prints = [fingerprint(r[1]) for r in rows]
    groups = components(prints, 4)
    least = defaultdict(list)
    for r, g in zip(rows, groups, strict=True):
        if r[0] is not None:
            least[g].append(r[0])
    for r, p, g in zip(rows, prints, groups, strict=True):
        assert (int(by[r[0]][0]["fingerprint"], 16), by[r[0]][0]["component_id"]) == (p, min(least[g]) if least[g] else None)


def test_op6(spark, tables):
    columns, rows, by = run(spark, tables, "op6_quality")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    same_rows(tables[1], by)
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    text = {r[0]: r[1] or "" for r in tables[1]}
    scores = {}
    for r in rows:  # the text alone decides
        assert scores.setdefault(text[r["doc_id"]], r["score"]) == r["score"]


def test_op7(spark, tables):
    _, _, by = run(spark, tables, "op7_quality_rules")
    same_rows(tables[1], by)
    for i, text, *_ in tables[1]:
        raw = (text or "").encode().split()
        windows = Counter(tuple(raw[k : k + 8]) for k in range(len(raw) - 7))
        covered = {j for k in range(len(raw) - 7) if windows[tuple(raw[k : k + 8])] > 1 for j in range(k, k + 8)}
        r = by[i][0]
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(raw), len(covered), sum(len(w.decode()) for w in raw))
        assert r["base_failed"] == (len(raw) < 20 or 100 * len(covered) > 30 * len(raw)) and not (r["base_failed"] and r["kept"])


def test_op8(spark, tables):
    columns, rows, by = run(spark, tables, "op8_sharding")
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    same = {k: sorted(v, key=str) for k, v in by.items()}
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in tables[1])

    def place(key, n):
        return max(range(n), key=lambda k: -1 / np.log(((xxhash.xxh64_intdigest(f"{key}#{k}", 42) >> 11) + 0.5) / 2**53))

    for i, text, *_ in tables[1]:
        raw = (text or "").encode()
        key = str(i) if i is not None else f"crc:{zlib.crc32(raw)}"
        r = same[i][0]
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "key", place(key, 16), place(key, 17))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op10(spark, tables):
    _, rows, _ = run(spark, tables, "op10_decontamination")
    expected = set()
    for i, text, *_ in tables[1]:
        t = normalise((text or "").encode())
        for k, item in enumerate(tables[2]):
            m = normalise(item.encode())
            budget = int(0.08 * len(m))
            if m and (f" {m} " in f" {t} " if not budget else len(t) < 5000 and edit_distance_anywhere(m, t) <= budget):
                expected.add((i, k))
    assert {(r["doc_id"], r["item_id"]) for r in rows} == expected and (N + 5, 1) in expected and (N + 4, 1) in expected


def test_long_texts_are_read_whole(spark):
    from pyspark.sql import functions as F

    from loomgraph.llm import decontamination, lm, mixing, quality, sharding, simhash

    item = "quick brown foxes jump over lazy dogs near the old river bank"
    long = "word " * 300_000 + item  # 1.5 MB, the item at its very end
    df = spark.createDataFrame([(1, long, "en", "s"), (2, "short text", "en", "s")], "doc_id bigint, text string, lang string, source string")
    n = len(long.split())
    assert {r["doc_id"]: r["mix_size"] for r in mixing.with_copies(df).collect()} == {1: n, 2: 2}
    assert {r["doc_id"]: r["size"] for r in sharding.shard_slots(df).collect()} == {1: len(long) + 1, 2: 11}
    assert [r["doc_id"] for r in decontamination.contaminated(df, spark.createDataFrame([(7, item)], "item_id int, text string")).collect()] == [1]
    assert {r["doc_id"]: r["n_tokens"] for r in lm.score_texts(df, F.lit(1), order=3).collect()} == {1: n + 1, 2: 3}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.near_duplicates(df).collect()} == {1: fingerprint(long), 2: fingerprint("short text")}
    model = quality.train(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int"), F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(df, model).collect())
