"""Neighbours and quotes by keys against all pairs."""

import numpy as np

from loomgraph.operators import alignment, evidence


def test_best_neighbours_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(f"t{i % 3}", f"n{i:03d}", [float(x) for x in rng.normal(size=6)]) for i in range(90)]
    rows += [("t0", "twin", rows[0][2]), ("t0", "a twin", rows[0][2]), ("t9", "alone", [1.0] * 6), ("t1", "zero", [0.0] * 6)]
    df = spark.createDataFrame(rows, "type string, name string, vector array<float>")
    unit = {n: np.array(v) / (np.linalg.norm(v) or 1) for _, n, v in rows}
    expected = {}
    for t, n, _ in rows:
        others = sorted((-round(float(np.float32(unit[n]) @ np.float32(unit[m])), 5), m) for u, m, _ in rows if u == t and m != n and m != "zero")
        if others and n != "zero" and -others[0][0] >= 0.3:
            expected[n] = (others[0][1], -others[0][0])
    for block in (2048, 7):
        found = {r["name"]: (r["candidate"], round(r["similarity"], 5)) for r in alignment.best_neighbours(df, 0.3, block=block).collect()}
        assert found.keys() == expected.keys()
        assert all(found[n][0] == expected[n][0] and abs(found[n][1] - expected[n][1]) < 1e-4 for n in found)
    assert found["n000"][0] == "a twin" and found["twin"][0] == "a twin" and found["a twin"][0] == "n000"


def test_quotes_are_found_wherever_they_stand(spark):
    docs = ["one two three four five six seven eight nine", "xone two three  four five six seven eight", "nothing here", None, "a b", ""]
    quotes = ["one two three four five six seven", "wo three four five six seven eigh", "three  four five", "b", "six", None, "", "seven eight nine ten eleven twelve thirteen"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string")
    expected = {(i, k, t.find(x)) for i, t in enumerate(docs) for k, x in enumerate(quotes) if t and x and x in t}
    assert {tuple(r) for r in evidence.quote_places(d, q, "doc_id", "item_id").collect()} == expected
