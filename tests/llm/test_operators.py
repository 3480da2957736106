"""Corpus operators against brute force, and the cases that must not crash them."""

import json
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, language, licenses, lm, mixing, quality, rules, sharding, simhash, tokens

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang if isinstance(lang, str) or lang is None else lang[i], source if isinstance(source, str) else source[i], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


#: Nulls, empty and blank texts, ties and repeated rows, a long text, odd characters.
ODD = [None, "", " \n\t ", "a", "a", "word " * 3000, "Ünï çødé 漢字 🙂 | # <b>", "A b\nA b\nA b", "x\x00y\x1cz\x85w", "the cat sat on the mat " * 40, "<|endoftext|> it's 'll 123 <|endoftext|>x"]


def odd(spark):
    """ODD with null ids, languages and sources, a repeated row, and columns whose names clash."""
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", 0) for i, t in enumerate(ODD)]
    rows += [(None, "null id here", None, None, None), (3, "a", None, "s0", 0), (3, "a", None, "s0", 0)]
    extra = {c: F.lit(0) for c in ("size", "score", "label", "shard", "rank", "fp", "draw", "token", "target", "held", "chunk")}
    return spark.createDataFrame(rows, DOCS).withColumns(extra)


def words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()


def every_operator(df):
    empty = df.sparkSession.createDataFrame([], "doc_id bigint, quality int, toxic int")
    benchmark = df.sparkSession.createDataFrame([(1, "the cat sat on the mat the cat"), (2, None), (3, "")], "item_id bigint, text string")
    learns = F.lit(True)
    yield language.identify(df, language.train(df, learns))
    yield lm.score_texts(df, F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1))
    yield tokens.count_tokens(df)
    yield simhash.near_duplicates(df)
    yield mixing.with_copies(df)
    yield quality.score_quality(df, quality.train(df, empty, learns))
    yield rules.apply_rules(df)
    yield sharding.shard_slots(df)
    yield licenses.scan_licenses(df)
    yield decontamination.contaminated(df, benchmark)


def test_odd_rows_and_empty_tables(spark):
    df = odd(spark)
    n = df.count()
    counts = [out.count() for out in every_operator(df)]
    assert counts[:-1] == [n] * 9
    assert [out.count() for out in every_operator(df.where("false"))] == [0] * 10
    assert simhash.keep_one_each(df).columns == df.columns and mixing.mix(df).columns == df.columns
    assert decontamination.clean(df, spark.createDataFrame([], "item_id bigint, text string")).count() == n


def test_language(spark):
    texts = ["the house and the garden", "das Haus und der Garten", "la maison et le jardin"] * 8 + ["gardening houses", "Gartenhaus", "12 34"]
    lang = ["en", "de", "fr"] * 8 + [None] * 3
    df = docs(spark, texts, lang)
    model = language.train(df, F.col("lang").isNotNull())
    found = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert all(found[i]["lang_pred"] == lang[i] for i in range(24))
    assert found[24]["lang_pred"] == "en" and found[25]["lang_pred"] == "de" and found[26]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert "gardening" not in model.index[0] and model.unseen("gardening").argmax() == model.languages.index("en")


def test_language_model_against_brute_force(spark):
    rng = np.random.default_rng(1)

    def chain(n):  # each word mostly decides the next one
        k, out = int(rng.integers(60)), []
        for _ in range(n):
            out.append(f"w{k}")
            k = (3 * k + 1) % 60 if rng.random() < 0.7 else int(rng.zipf(1.6)) % 60
        return " ".join(out)

    texts = [chain(int(n)) for n in rng.integers(0, 80, 120)] + [None, ""]
    df = docs(spark, texts)
    part = {i: 0 if i % 7 == 2 else 2 if i % 5 == 0 else 1 for i in range(len(texts))}
    out = {r["doc_id"]: r for r in lm.score_texts(df, F.when(F.col("doc_id") % 7 == 2, 0).when(F.col("doc_id") % 5 == 0, 2).otherwise(1), chunk_bytes=900).collect()}
    seq = [[*words(t), None] for t in texts]  # None: the end
    uni, bi, ret1, ret2, held2 = Counter(), Counter(), Counter(), Counter(), Counter()
    starts = Counter()
    for i, s in enumerate(seq):
        pairs = list(zip(["start", *s[:-1]], s))
        if part[i]:
            uni.update(s), bi.update(pairs), starts.update(["all"] + ["ret"] * (part[i] == 1))
        if part[i] == 1:
            ret1.update(s), ret2.update(pairs)
        if part[i] == 2:
            held2.update(pairs)
    n, v, n_ret = sum(uni.values()), len(uni), sum(ret1.values())
    base = [sum(log10((uni[w] + 1) / (n + v + 1)) for w in s) for s in seq]
    assert all(out[i]["train_tokens"] == n and out[i]["n_tokens"] == len(s) and out[i]["n_known"] == sum(uni[w] > 0 for w in s) for i, s in enumerate(seq))
    assert max(abs(out[i]["base_score"] - b) for i, b in enumerate(base)) < 1e-9
    cells = []
    for (a, w), k in held2.items():
        c = starts["ret"] if a == "start" else ret1[a]
        cells.append((int(lm.bucket(np.array([c]))[0]), k, ret2[a, w] / c if c else 0.0, ret1[w] / n_ret))
    weights = lm.learn_weights(np.array(sorted(cells), float), 1 / (v + 1))
    worst = 0.0
    for i, s in enumerate(seq):
        score = 0.0
        for a, w in zip(["start", *s[:-1]], s):
            c = starts["all"] if a == "start" else uni[a]
            l = weights[int(lm.bucket(np.array([c]))[0])]
            score += log10(l[0] * (bi[a, w] / c if c else 0) + l[1] * uni[w] / n + l[2] / (v + 1))
        worst = max(worst, abs(score - out[i]["score"]) / len(s))
    assert worst < 1e-3  # events of nearly equal ratios share a cell while weights are learned
    outside = [i for i in out if part[i] == 0]
    assert sum(out[i]["score"] for i in outside) > sum(out[i]["base_score"] for i in outside)


def test_long_texts_are_pieces(spark):
    texts = ["a b c a b d e f g h " * 3, "b c a", "a b"]
    whole = {r["doc_id"]: r for r in lm.score_texts(docs(spark, texts), F.lit(1)).collect()}
    before = lm._PIECE_WORDS
    try:
        lm._PIECE_WORDS = 4
        encoded = lm.encode(docs(spark, texts).coalesce(1), F.lit(1), "doc_id", "text", 10)
        assert encoded.count() > 1
    finally:
        lm._PIECE_WORDS = before
    assert whole[0]["n_tokens"] == 31


def test_weights_are_those_of_a_mixture():
    cells = np.array([(3, 900, 0.5, 0.01), (3, 100, 0.0, 0.01)], float)
    w = lm.learn_weights(cells, 1e-4)[3]
    assert w[0] > 0.85 and abs(w.sum() - 1) < 1e-9
    assert lm.learn_weights(np.zeros((0, 4)), 0.1)[0][0] == 0.0


def test_token_counts_equal_the_library(spark):
    texts = [*ODD, "Lettersonly" * 900, ("It's 12,345  tests;\n\n\tof (many) kinds! é漢 " * 200), "x " * 500 + "y" * 5000 + " z" * 500]
    tokenizer = tokens.load_tokenizer("byte_bpe_50k.json")
    expected = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for window, overlap in ((200, 16), (1000, 4), (1 << 16, 1 << 10)):
        out = {r["doc_id"]: r for r in tokens.count_tokens(docs(spark, texts), window=window, overlap=overlap).collect()}
        assert [out[i]["n_tokens"] for i in range(len(texts))] == expected
    assert out[0]["n_bytes"] == 0 and out[6]["n_bytes"] == len(ODD[6].encode()) and out[5]["over_limit"]


def test_splice_points_are_shown_by_both_chunks():
    tokenizer = tokens.load_tokenizer("byte_bpe_50k.json")
    text = "alpha beta gamma delta epsilon zeta eta theta"
    left, right = tokens._Chunk(tokenizer, text, 0, 30), tokens._Chunk(tokenizer, text, 12, len(text))
    p = tokens.splice_point(text, left, right, 0)
    assert text[p - 1].isalpha() and text[p] == " "
    assert tokens.splice_point("a" * 50, tokens._Chunk(tokenizer, "a" * 50, 0, 30), tokens._Chunk(tokenizer, "a" * 50, 20, 50), 0) is None


def fingerprint(text):
    w = words(text)
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{int(k)}" for k in rng.integers(0, 400, 120)) for _ in range(15)]
    texts = list(base)
    for t in base[:8]:
        for _ in range(4):
            w = t.split()
            w[int(rng.integers(len(w)))] = "changed"
            texts.append(" ".join(w))
    texts += base[:3] + ["", None, "Two words", "two  WORDS"]
    out = sorted(simhash.near_duplicates(docs(spark, texts)).collect(), key=lambda r: r["doc_id"])
    expected = [fingerprint(t) for t in texts]
    assert [int(r["fingerprint"], 16) for r in out] == expected
    assert [r["component_id"] for r in out] == components(expected, 4)
    kept = {r["doc_id"] for r in simhash.keep_one_each(docs(spark, texts)).collect()}
    assert kept == set(components(expected, 4))


def test_rows_stay_or_go_by_themselves_without_ids_or_with_shared_ones(spark):
    rng = np.random.default_rng(13)
    texts = [" ".join(f"w{int(k)}" for k in rng.integers(0, 400, 60)) for _ in range(7)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5]), (None, texts[5]), (9, texts[6]), (9, texts[6])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted((r["text"], r["doc_id"]) for r in simhash.keep_one_each(df).collect())
    assert kept == sorted(zip(texts, [None, None, None, 7, 7, 8, 9], strict=True))
    items = spark.createDataFrame([(1, texts[1]), (2, texts[4])], "item_id bigint, text string")
    left = Counter((r["doc_id"], r["text"]) for r in decontamination.clean(df, items).collect())
    assert left == Counter(r for r in rows if r[1] not in (texts[1], texts[4]))


@pytest.mark.parametrize("at_once", [1 << 22, 64])
def test_ball_hashing_finds_all_links_and_no_others(spark, monkeypatch, at_once):
    rng = np.random.default_rng(5)
    values = [int(x) for x in rng.integers(0, 1 << 63, 30, dtype=np.uint64)]
    for v in values[:12]:
        for d in (1, 2, 3, 4, 5, 6):
            bits = rng.choice(64, d, replace=False)
            values.append(v ^ sum(1 << int(b) for b in bits))
    fps = np.unique(np.array(values, np.uint64))
    monkeypatch.setattr(simhash, "_AT_ONCE", at_once)
    pairs = [(int(a), int(b)) for x, y in simhash.collisions([fps, fps[:0], fps[:0]], 64, 2) for a, b in zip(x, y)]
    assert pairs and all((a ^ b).bit_count() <= 4 for a, b in pairs)
    place = {int(v): i for i, v in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(place[a]), find(place[b])))
        parent[y] = x
    assert [find(i) for i in range(len(fps))] == components([int(v) for v in fps], 4)


def test_prefix_rows_stand_for_all_variants(spark):
    rng = np.random.default_rng(9)
    v = int(rng.integers(0, 1 << 63))
    chain = [v, v ^ (0b11 << 62), v ^ (0b11 << 62) ^ (0b1001 << 50), v ^ 0b1111]
    df = spark.createDataFrame([(np.uint64(x).view(np.int64).item(),) for x in chain], "fp bigint")
    linked = simhash.links(df, 1 << 20).collect()  # a long prefix, as for a large table
    nodes = {r["a"] for r in linked} | {r["b"] for r in linked}
    assert len(nodes) == 4


def test_mixing_against_brute_force(spark):
    rng = np.random.default_rng(2)
    source = [["b", "a", None, "z", "empty"][int(k)] for k in rng.choice(5, 400, p=[0.5, 0.2, 0.1, 0.15, 0.05])]
    texts = ["" if s == "empty" else "w " * int(n) for s, n in zip(source, rng.integers(1, 60, 400))]
    out = {r["doc_id"]: r for r in mixing.with_copies(docs(spark, texts, source=source)).collect()}
    size = defaultdict(int)
    for s, t in zip(source, texts):
        size[s] += len(t.split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        free -= full
    target |= {s: weight[s] * level for s in free}
    taken = defaultdict(int)
    for i, s in enumerate(source):
        r = out[i]
        assert r["mix_source_size"] == size[s] and abs(r["mix_target"] - target[s]) < 1e-6 and 0 <= r["mix_copies"] <= 2
        taken[s] += r["mix_size"] * r["mix_copies"]
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in names)
    assert mixing.mix(docs(spark, texts, source=source)).count() == sum(r["mix_copies"] for r in out.values())


def test_quality_separates_junk_and_keeps_clean(spark):
    rng = np.random.default_rng(4)

    def text(junk):
        w = ["the", "house", "stands", "quietly", "near", "old", "rivers", "and", "hills"]
        t = " ".join(rng.choice(w, int(rng.integers(20, 90))))
        return t.upper().replace(" ", "!! ") if junk == 1 else t.replace(" ", "### ") if junk == 2 else t.capitalize() + "."

    kinds = [int(k) for k in rng.choice(3, 600, p=[0.8, 0.1, 0.1])]
    df = docs(spark, [text(k) for k in kinds])
    labels = spark.createDataFrame([(i, int(k == 0)) for i, k in enumerate(kinds)] + [(None, 1), (5, int(kinds[5] == 0))], "doc_id bigint, quality int")
    model = quality.train(df, labels, F.col("doc_id") % 4 != 2)
    out = {r["doc_id"]: r["score"] for r in quality.score_quality(df, model).collect()}
    held = [i for i in out if i % 4 == 2]
    assert np.mean([(out[i] >= 0.7) == (kinds[i] == 0) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in out.values())


def test_discriminant_is_the_difference_of_gaussian_densities():
    rng = np.random.default_rng(6)
    d = len(quality.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (80, d)), rng.normal(1, 2, (60, d))])
    y = np.array([0] * 80 + [1] * 60)
    model = quality.fit(x, y)
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k].T @ model.factors[k])
        z = (x[:5] - model.center) / model.scale - model.means[k]
        expected = np.log(np.mean(y == k)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.sum(z @ np.linalg.inv(cov) * z, axis=1)
        assert np.allclose(model.log_density(x[:5], k), expected)


def test_rule_statistics_against_brute_force():
    rng = np.random.default_rng(8)
    for case in range(60):
        w = [f"w{int(k)}" for k in rng.integers(0, 30, int(rng.integers(0, 200)))]
        if case % 3 == 0:
            w = w[:20] * 3 + w
        seps = rng.choice([" ", "\n", "\t", " # "], len(w))
        text = "".join(a + b for a, b in zip(w, seps)) + "é"
        raw = text.encode()
        tokens_ = raw.split()
        windows = Counter(tuple(tokens_[i : i + 8]) for i in range(len(tokens_) - 7))
        covered = {j for i in range(len(tokens_) - 7) if windows[tuple(tokens_[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        expected = (len(tokens_), sum(len(t.decode()) for t in tokens_), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert rules.text_statistics(raw) == expected


def test_kneser_ney_is_a_distribution_and_grams_are_whole(monkeypatch):
    rng = np.random.default_rng(10)
    text = bytes(rng.choice(list(b"abc de\nXY.1"), 3000).astype(np.uint8).tolist())
    whole = np.concatenate(list(rules.grams(text)))
    symbols = [0, 0, 0, *rules.SYMBOLS[np.frombuffer(text, np.uint8)].tolist(), 0]
    assert whole.tolist() == [((symbols[i] * 32 + symbols[i + 1]) * 32 + symbols[i + 2]) * 32 + symbols[i + 3] for i in range(len(text) + 1)]
    monkeypatch.setattr(rules, "_PIECE", 7)
    assert np.concatenate(list(rules.grams(text))).tolist() == whole.tolist()
    assert np.concatenate(list(rules.grams(b""))).tolist() == [0]
    model = rules.KneserNey.train(np.bincount(whole, minlength=1 << 20))
    assert all((h[1:] > h[:-1]).all() for h in model.hashes)
    p = 10.0 ** model.log_probabilities().reshape(-1, 32).astype(float)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_rules_reject_odd_texts_and_keep_clean_ones(spark):
    rng = np.random.default_rng(11)
    w = ["the", "house", "stands", "quietly", "near", "old", "rivers", "and", "hills", "under", "bright", "skies"]
    texts = [" ".join(rng.choice(w, 80)).capitalize() + "." for _ in range(200)] + ["#@! " * 60 + "zq xj " * 40, "few words only", "same eight words come here again and again " * 9]
    out = {r["doc_id"]: r for r in rules.apply_rules(docs(spark, texts)).collect()}
    assert sum(out[i]["kept"] for i in range(200)) >= 199
    assert not out[200]["kept"] and not out[201]["kept"] and out[201]["base_failed"] and out[202]["base_failed"]


def test_perplexity_band_rejects_junk_and_keeps_short_clean_texts(spark):
    rng = np.random.default_rng(12)
    w = ["the", "house", "stands", "quietly", "near", "old", "rivers", "and", "hills", "under", "bright", "skies"]
    texts = [" ".join(rng.choice(w, int(rng.choice([25, 60, 150, 400])))).capitalize() + "." for _ in range(300)]
    junk = [" ".join(x if rng.random() < 0.7 else str(rng.choice(["###", "$$$", "%%%"])) for x in rng.choice(w, 150)) for _ in range(12)]
    out = {r["doc_id"]: r for r in rules.apply_rules(docs(spark, texts + junk)).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert sum(out[i]["kept"] for i in range(300)) >= 297
    assert not any(out[i]["kept"] for i in range(300, 312))


def test_shards_are_weighted_stable_and_gapless(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    df = df.unionByName(spark.range(9000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("t7").alias("text")))
    out = sharding.shard_slots(df, buckets=16).toPandas()
    assert len(out) == 13000
    for _, group in out.groupby("shard"):
        assert sorted(group["slot"]) == list(range(len(group)))
    moved = out[out["grown_shard"] != out["shard"]]
    assert (moved["grown_shard"] == 16).all() and 0 < moved["doc_id"].nunique() < 400
    assert (out["text_crc32"] == [zlib.crc32(f"t{i}".encode()) for i in out["doc_id"]]).all()

    def unit(key, k):
        return ((xxhash.xxh64_intdigest(f"{key}#{k}", 42) >> 11) + 0.5) / 2**53

    first = out.drop_duplicates("doc_id").head(50)
    assert all(r.shard == max(range(16), key=lambda k: -1 / np.log(unit(r.doc_id, k))) for r in first.itertuples())
    weighted = sharding.assign_shards(df.where("doc_id <> 7"), (3.0, 1.0)).groupBy("shard").count().collect()
    counts = {r["shard"]: r["count"] for r in weighted}
    assert 2.5 < counts[0] / counts[1] < 3.6


def test_written_shards(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sharding.write_shards(df, str(tmp_path / "out"), (1.0,) * 4, files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def license_truth(text):
    w, cur = [], ""
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in low + " ":
        if c > "\x7f" or c.isdigit() or ("a" <= c <= "z"):
            cur += c
        elif cur:
            w.append(cur)
            cur = ""
    starts = sorted(i for i in range(len(w)) for _, p in licenses.PHRASES if tuple(w[i : i + len(p)]) == p)
    base = {label for i in range(len(w)) for label, p in licenses.PHRASES if tuple(w[i : i + len(p)]) == p}
    labels, best = set(base), 1.0 if starts else 0.0
    for line in low.split("\n"):
        have = {t for t in "".join(c if c > "\x7f" or c.isdigit() or "a" <= c <= "z" else " " for c in line).split(" ") if t}
        scored = []
        for label, template in licenses.TEMPLATES:
            t = set(licenses.template_tokens(template))
            share = len(t & have)
            if share >= 0.8 * len(t) - 1e-9:
                scored.append((share / len(t), share, label))
        if scored:
            top = max(s[:2] for s in scored)
            labels |= {s[2] for s in scored if s[:2] == top}
            best = max(best, top[0])
    return len(w), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)), best


def test_licenses_against_brute_force(spark):
    texts = [
        *ODD,
        "Released under the MIT License.",
        "mit license mit LICENSE, mit-license",
        "Intro\nLicensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0",
        "mit the Kelvin License miT LİCENSE",
        "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated files",
        "licensed under gnu lesser general public license version 3 or later",
        "Licensed under the\nApache License",
    ]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])
        assert got == license_truth(t), (t, got, license_truth(t))


def edit_distance_anywhere(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(12)
    vocabulary = ["alpha", "beta", "gamma", "delta", "river", "stone", "quiet", "morning", "window", "garden"]
    items = [" ".join(rng.choice(vocabulary, 14)) for _ in range(6)]
    texts = []
    for k in range(60):
        fill = [" ".join(rng.choice(vocabulary, 30)) for _ in range(2)]
        item = list(items[k % 6])
        for _ in range(k // 6):
            p = int(rng.integers(len(item)))
            item[p : p + 1] = [[], ["x"], [item[p], "q"]][int(rng.integers(3))]
        texts.append(f"{fill[0]} {''.join(item)} {fill[1]}" if k % 2 else f"{fill[0].upper()}\n{''.join(item).upper()}!!  {fill[1]}")
    df = docs(spark, [*texts, None, "", " ".join(rng.choice(vocabulary, 50))])
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(98, None), (99, " !! ")], "item_id bigint, text string")
    expected = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            d = edit_distance_anywhere(decontamination.normalise(item.encode()), decontamination.normalise(t.encode()))
            if d <= int(0.08 * len(decontamination.normalise(item.encode()))):
                expected[i, j] = d
    for block in (4_000_000, 150):
        found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.contaminated(df, benchmark, block_chars=block).collect()}
        found = {k: v for k, v in found.items() if k[0] < len(texts)}
        assert found == expected and len(expected) >= 20
    assert {r["doc_id"] for r in decontamination.clean(df, benchmark).collect()} == set(range(63)) - {k[0] for k in expected} - {r["doc_id"] for r in decontamination.contaminated(df, benchmark).collect()}


def test_myers_equals_the_table():
    rng = np.random.default_rng(13)
    for _ in range(200):
        item = "".join(rng.choice(list("abc "), int(rng.integers(1, 90))))
        text = "".join(rng.choice(list("abc "), int(rng.integers(0, 150))))
        assert decontamination.Pattern(item).best(text)[0] == edit_distance_anywhere(item, text)


def test_registered_names():
    from loomgraph.llm.queries import ORACLES, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and json.dumps(sorted(ORACLES))
