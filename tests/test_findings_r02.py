"""Cases of the findings of round 2 on fuzzy matching."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from spanloom.plans import fuzzy


def test_what_meets_by_chance_ends_inside_the_join(spark):
    """Texts of the same frequent triples: nearly all pairs meet, few may be close."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ка", "ро", "ми", "ле"]) for _ in range(9)) for _ in range(300)]
    texts = [(k, t, f"-{t}-") for k, t in enumerate(sorted(set(texts)))]
    df = spark.createDataFrame(texts, "first long, low string, p string").selectExpr("first", "length(low) n", "p")
    kind = "first long, n int, size int, counts array<int>, b0 long, b1 long, prefix array<long>"
    features = df.mapInArrow(fuzzy._features([0], 0.85), kind)
    met = {(r["other"], r["first"]) for r in fuzzy._meet(features, 0.85).collect()}

    def shares(a, b):
        x, y = list(fuzzy._codes(a)), list(fuzzy._codes(b))
        return sum(min(x.count(g), y.count(g)) for g in set(x)) >= max(len(x), len(y)) - 3 * 2

    # Of those that share enough and meet none is dropped; of the others hardly one remains.
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    enough = {(i, j) for i, j in pairs if shares(texts[i][2], texts[j][2])}
    assert enough <= met and len(enough) > 100 and len(met) < 0.25 * len(pairs)


def test_cosines_of_many_pairs_equal_those_one_by_one():
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("абв ") for _ in range(rng.choice([0, 1, 2, 9, 30])))
    rows = [(k, k + 1, a, b, f"-{a}-", f"-{b}-") for k in range(500) for a in [text()] for b in [a[1:] if k % 2 else text()]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["first", "other", "low_a", "low_b", "p_a", "p_b"])
    want = []
    for first, _, a, b, p, q in rows:
        x, nx = np.unique(fuzzy._codes(p), return_counts=True)
        y, ny = np.unique(fuzzy._codes(q), return_counts=True)
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        if np.minimum(nx[i], ny[j]).sum() >= max(1, max(nx.sum(), ny.sum()) - 3 * math.floor(0.15 * max(len(a), len(b)) + 1e-9)):
            want.append((first, round(float(nx[i] @ ny[j]) / math.sqrt(float(nx @ nx) * float(ny @ ny)), 9)))
    got = [(r["first"], r["cosine"]) for out in fuzzy._cosines(0.85, 64)([batch]) for r in out.to_pylist()]
    assert got == want and len(got) > 100
    one = [(r["first"], r["cosine"]) for out in fuzzy._cosines(0.85, 64, 0)([batch]) for r in out.to_pylist()]
    assert one == want


def test_a_run_is_cut_from_its_sentence(spark):
    from spanloom.operators import extract

    text = "Нужен Go. «Machine learning» и\n\nгo, İ go!  Пишем на go lang." * 3
    texts = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    kw = spark.createDataFrame([(1, "go", "T"), (2, "machine learning", "S"), (3, "go lang", "T"), (4, "i̇ go", "X")], "id long, value string, type string")
    out = extract.extract_by_dictionary(texts, kw)
    made = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if " AS value#" in x and "r#" in x]
    assert made and all("sent#" in x and "text#" not in x for x in made)
    got = {r["id"]: [text[e["start"] : e["end"]].lower() for e in r["entities"]] for r in out.collect()}
    assert got == {1: ["go", "machine learning", "i̇ go", "go lang"] * 3, 2: [], 3: []}


def test_long_texts_meet_by_bits_only(spark):
    """of long texts of common triples hardly a pair meets but those that share enough, however blocks and tiles are cut."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["ка", "ро", "ми", "ле", "су"]) for _ in range(3)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([30, 30, 31, 60, 125]))) for _ in range(160)]
    for k in range(60):
        t = list(texts[k])
        for _ in range(rng.randrange(1, 2 + len(t) // 20)):
            i = rng.randrange(len(t))
            t[i : i + rng.randrange(2)] = rng.choice(["", "ю", "эя"])
        texts.append("".join(t))
    texts = sorted(set(texts + ["ю", ""]), key=lambda t: (t[::-1], t))
    df = spark.createDataFrame([(k, len(t), f"-{t}-") for k, t in enumerate(texts)], "first long, n int, p string")
    near = lambda *a: [(r["other"], r["first"]) for r in fuzzy._near(df, 0.95, *a).collect()]
    met = near()
    counts = [Counter(fuzzy._codes(f"-{t}-").tolist()) for t in texts]
    edits = lambda i, j: math.floor((1 - 0.95) * max(len(texts[i]), len(texts[j])) + 1e-9)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if abs(len(texts[i]) - len(texts[j])) <= edits(i, j)]
    shares = lambda i, j: (counts[i] & counts[j]).total() >= max(1, max(counts[i].total(), counts[j].total()) - 3 * edits(i, j))
    enough = {(i, j) for i, j in pairs if shares(i, j)}
    assert len(met) == len(set(met)) and enough <= set(met) and len(enough) > 40
    assert len(met) < len(enough) + 0.05 * len(pairs) and len(pairs) > 3000
    assert sorted(near(1000, (500, 500))) == sorted(near(1, (10**9, 10**9))) == sorted(met)
    table = pa.table({"block": [0] * len(texts), "own": [int(len(t) > 330) for t in texts], "first": range(len(texts)), "n": [len(t) for t in texts]})
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(k, len(t), f"-{t}-") for k, t in enumerate(texts)])], names=["first", "n", "p"])
    made = next(fuzzy._parities([batch]))
    table = table.append_column("size", made.column("size")).append_column("bits", made.column("bits"))
    cut = [sorted(zip(*fuzzy._block_pairs(0.95, tile)(table).to_pydict().values())) for tile in ((256, 512), (3, 7), (8, 2), (1, 1))]
    assert cut[0] == cut[1] == cut[2] == cut[3] and cut[0]
