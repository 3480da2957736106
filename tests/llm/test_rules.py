"""The perplexity model of the quality rules against brute force, its parts, and its band on noise."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import rules

SCHEMA = "doc_id bigint, text string, lang string"


def grams(text):
    s = [0, 0, 0, *map(ord, text), 0]
    return [tuple(s[i : i + 4]) for i in range(len(s) - 3)]


def plain_model(texts):
    """p of each 4-gram's last symbol by the formulas of modified Kneser-Ney, from dictionaries."""
    counts = {4: Counter(g for t in texts for g in grams(t))}
    for n in (3, 2, 1):
        counts[n] = Counter()
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    tables = {}
    for n, table in counts.items():
        of = [max(1.0, sum(c == k for c in table.values())) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        d = [min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.05), 0.95 * k) for k in (1, 2, 3)]
        total, off = Counter(), defaultdict(float)
        for g, c in table.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
        tables[n] = table, d, total, off

    def p(g):
        if not g:
            return 1 / len(counts[1])
        table, d, total, off = tables[len(g)]
        own = (table[g] - d[min(table[g], 3) - 1]) / total[g[:-1]] if table[g] else 0.0
        return own + off[g[:-1]] / total[g[:-1]] * p(g[1:])

    return counts, p


def key(g):
    value = 0
    for c in g:
        value = value << 16 | c
    return value


TEXTS = ["the cat sat on the mat", "the dog sat", "Кот сидел на мате", "a", "", "été à la mer, l'été", "漢字漢字", "the cat sat on the mat"]


def test_counts_discounts_and_probabilities_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    counts, p = plain_model(TEXTS)
    found = rules.gram_counts(df)
    assert {int(np.int64(r["key"]).view(np.uint64)): r["n"] for r in found.collect()} == {key(g): c for g, c in counts[4].items()}
    model = {int(np.int64(r["key"]).view(np.uint64)): r["p"] for r in rules.kneser_ney(found).collect()}
    assert len(model) == len(counts[4])
    assert all(model[key(g)] == pytest.approx(p(g), rel=1e-9) for g in counts[4])
    symbols = [g[0] for g in counts[1]]
    for context in ((0, 0, 0), (ord("t"), ord("h"), ord("e")), (ord(" "), ord("s"), ord("a"))):
        assert sum(p((*context, c)) for c in symbols) == pytest.approx(1)
    out = {r["doc_id"]: r["perplexity"] for r in rules.apply_rules(df).collect()}
    for i, t in enumerate(TEXTS):
        g = grams(t)
        assert out[i] == pytest.approx(np.exp(-sum(np.log(p(x)) for x in g) / len(g)), rel=1e-5)


def test_keys_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "aé漢🙂\x00 b\n" * 5
    whole = np.concatenate(list(rules.point_grams(text)))
    assert len(whole) == len(text) + 1
    for piece in (1, 2, 3, 4, 7, len(text), len(text) + 1):
        monkeypatch.setattr(rules, "_PIECE", piece)
        assert np.concatenate(list(rules.point_grams(text))).tolist() == whole.tolist()
        assert np.concatenate(list(rules.point_grams(""))).tolist() == [0]


def test_parts_of_the_model_give_the_same_rows(spark):
    rng = np.random.default_rng(2)
    w = ["one", "two", "дом", "река", "haus", "fluss"]
    rows = [(i % 40, " ".join(rng.choice(w[2 * (i % 3) :][:2], 30)) + str(i), [None, "ru", "de"][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, rules.apply_rules(df).collect()), key=str)
    for most in (150, 20):  # a language or two at once; ranges of one
        cut = sorted(map(tuple, rules.apply_rules(df, most_grams=most).collect()), key=str)
        assert [x[:8] + x[9:] for x in cut] == [x[:8] + x[9:] for x in whole]
        assert [x[8] for x in cut] == pytest.approx([x[8] for x in whole], rel=1e-6)


def test_noise_in_another_script_is_rejected(spark):
    rng = np.random.default_rng(7)
    w = ["дом", "река", "камень", "тихий", "утро", "окно", "сад", "под", "ясный", "небо", "идёт", "медленно"]
    clean = [" ".join(rng.choice(w, int(rng.integers(40, 120)))) for _ in range(150)]
    letters = list("абвгдежзийклмнопрстуфхцчшщъыьэюя")
    noise = [" ".join("".join(rng.choice(letters, int(rng.integers(2, 9)))) for _ in range(60)) for _ in range(6)]
    out = {r["doc_id"]: r for r in rules.apply_rules(spark.createDataFrame([(i, t, "ru") for i, t in enumerate(clean + noise)], SCHEMA)).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert sum(out[i]["kept"] for i in range(150)) >= 148 and not any(out[i]["kept"] for i in range(150, 156))


def test_values_of_odd_rows(spark):
    clean = " ".join(f"word{i % 9}" for i in range(25))
    rows = [(1, None, "en"), (2, "", None), (None, clean, "en"), (3, " \n\t", "en"), (4, clean, "en"), (4, clean, "en"), (5, "long " * 400_000, "fr")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("surprise", "length", "key", "n", "p")})
    out = rules.apply_rules(df).collect()
    assert len(out) == 7 and out[0].asDict().keys() == {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lang"}
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for i in (1, 2, 3):
        assert (by[i][0]["n_words"], by[i][0]["base_failed"], by[i][0]["kept"]) == (0, True, False)
    assert by[4][0] == by[4][1] and by[4][0]["n_words"] == by[None][0]["n_words"] == 25
    assert by[2][0]["lang"] is None and by[5][0]["n_words"] == 400_000 and by[5][0]["n_repeat_words"] == 400_000
    assert rules.apply_rules(df, symbols="classes").count() == 7
    assert rules.apply_rules(df.where("false")).count() == 0
