"""The pipeline against a plain version of its five stages, and the guard around it."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

import corpus_pipeline
from loomgraph.llm import decontamination, quality
from tests.llm.test_operators import components, edit_distance_anywhere, fingerprint


def tables(spark, folder):
    rng = np.random.default_rng(21)
    vocabulary = ["house", "river", "stone", "quiet", "morning", "window", "garden", "under", "bright", "skies", "walks", "slowly"]
    items = [" ".join(rng.choice(vocabulary, 12)) for _ in range(4)]
    rows, labels = [], []
    for i in range(260):
        kind = int(rng.choice(4, p=[0.7, 0.15, 0.1, 0.05]))
        text = " ".join(rng.choice(vocabulary, int(rng.integers(60, 140)))).capitalize() + "."
        if kind == 1:
            text = text.upper().replace(" ", "!! ") if i % 2 else text.replace(" ", "### ")
        elif kind == 2 and rows:
            text = rows[int(rng.integers(len(rows)))][1]
            words = text.split()
            words[len(words) // 2] = "altered"
            text = " ".join(words) if i % 2 else text
        elif kind == 3:
            text = f"{text} {items[i % 4].upper()}! {text}"
        rows.append((i, text, "en", [None, "b", "a"][i % 3], len(text)))
        if i % 5:
            labels.append((i, int(not any(m in text for m in ("!!", "###"))), 0))
    rows.append((None, None, None, None, None))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels, items


def plain(rows, labels, items):
    text = {r[0]: r[1] or "" for r in rows}
    source = {r[0]: r[3] for r in rows}
    learned = sorted((quality.features(text[i].encode()), q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    model = quality.fit(np.array([x for x, _ in learned]), np.array([q for _, q in learned]))
    kept = [i for i in text if model.score(np.array([quality.features(text[i].encode())]))[0] >= 0.7]
    with_id = [i for i in kept if i is not None]
    groups = components([fingerprint(text[i]) for i in with_id], 4)
    kept = [i for k, i in enumerate(with_id) if groups[k] == k] + [None] * (None in kept and fingerprint("") not in [fingerprint(text[i]) for i in with_id])
    normal = [decontamination.normalise(t.encode()) for t in items]

    def leaks(i):
        t = decontamination.normalise(text[i].encode())
        return any(edit_distance_anywhere(n, t) <= int(0.08 * len(n)) for n in normal)

    kept = [i for i in kept if not leaks(i)]
    size = {i: len(text[i].split()) for i in kept}
    total = defaultdict(int)
    for i in kept:
        total[source[i]] += size[i]
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(total.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = 2 * total[s]
            left -= target[s]
        free -= full

    def draw(i, k):
        key = str(i) if i is not None else hashlib.md5(b"").hexdigest()
        return int(hashlib.md5(f"mix-2024:{k // 4}:{key}".encode()).hexdigest()[k % 4 * 8 :][:8], 16) / 16**8

    out = Counter()
    for s in names:
        mine = [i for i in kept if source[i] == s]
        rate = target[s] / total[s] if total[s] else 0.0
        copies = [{i: min(2, int(rate) + (draw(i, k) < rate - int(rate))) for i in mine} for k in range(8)]
        best = min(range(8), key=lambda k: (abs(sum(size[i] * copies[k][i] for i in mine) - target[s]), k))
        for i in mine:
            key = str(i) if i is not None else "crc:0"
            shard = max(range(16), key=lambda k: -1 / np.log(((xxhash.xxh64_intdigest(f"{key}#{k}", 42) >> 11) + 0.5) / 2**53))
            out[i, shard] += copies[best][i]
    return +out


def test_pipeline_against_plain_version(spark, tmp_path):
    rows, labels, items = tables(spark, str(tmp_path))
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    found = Counter((r["doc_id"], r["shard"]) for r in result.collect())
    assert found == plain(rows, labels, items)
    assert 60 < len(found) < 240


def test_stages_on_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 5
