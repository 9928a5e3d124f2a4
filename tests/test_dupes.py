"""Duplicates, components and skew-safe joins against brute force."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from spanloom.plans import fuzzy, tfidf
from spanloom.plans.components import components
from spanloom.plans.skew import heavy_keys, lookup_join


def _brute(texts):
    tok = {i: Counter(re.findall(r"(?u)\b\w\w+\b", (t or "").lower())) for i, t in texts}
    df = Counter(w for c in tok.values() for w in c)
    n, vec = len(tok), {}
    for i, c in tok.items():
        v = {w: k * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in c.items()}
        norm = math.sqrt(sum(a * a for a in v.values()))
        vec[i] = {w: a / norm for w, a in v.items()}
    root = {i: i for i in tok}
    changed = True
    near = [(a, b) for a in tok for b in tok if a < b and (not tok[a] and not tok[b] or sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) >= 0.98)]
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    size = Counter(root.values())
    return {i: r for i, r in root.items() if size[r] > 1}


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"слово{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    texts = [(i, b) for i, b in enumerate(base)] + [(20 + i, b + " " + rng.choice(words)) for i, b in enumerate(base[:6])]
    texts += [(40, base[0]), (41, None), (42, ""), (43, "a"), (44, base[0].upper()), (45, " ".join(reversed(base[1].split())))]
    df = spark.createDataFrame(texts, "id long, text string")
    got = tfidf.duplicates(df).collect()
    assert {r["id"]: r["root_id"] for r in got} == _brute(texts)
    roots = sorted({r["root_id"] for r in got})
    assert all(r["cluster"] == roots.index(r["root_id"]) for r in got)
    assert {r["id"] for r in tfidf.duplicates(df, cluster_empty=False).collect()}.isdisjoint({41, 42, 43})
    assert tfidf.duplicates(df.limit(0)).count() == 0


def test_components_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


def test_fuzzy_examples(spark):
    df = lambda words: spark.createDataFrame(list(enumerate(words)), "idx long, text string")
    m = fuzzy.canonical(df("hello hello hello world world worldd".split()), 0.55, 3)
    assert {tuple(r) for r in m.collect()} == {(1, 0), (2, 0), (4, 3), (5, 3)}
    assert {(r["canonical"], tuple(r["members"])) for r in fuzzy.clusters(m).collect()} == {(0, (1, 2, 0)), (3, (4, 5, 3))}
    a, b = "abcdefghij" * 12, "abcdefghij" * 11 + "abcdefghiX"
    assert {tuple(r) for r in fuzzy.canonical(df([a, b, b, None])).collect()} == {(1, 0), (2, 1)}


def test_heavy_keys_take_another_way(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(1)).otherwise(F.col("id")).alias("k"), "id").unionByName(spark.range(1).select(F.lit(None).cast("long").alias("k"), "id"))
    look = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).where("k <> 2500")
    assert heavy_keys(rows, "k") == [1]
    got = lookup_join(rows, look, "k")
    assert got.count() == 3001 and got.where("v = 2").count() == 2000 and got.where("v is null").count() == 2
    assert "Broadcast" in got._jdf.queryExecution().toString()


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_close_documents_equal_brute_force(spark, tmp_path):
    from spanloom.queries import QUERIES

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randint(3, 9)))
    base = [" ".join(word() for _ in range(rng.randint(25, 40))) for _ in range(12)]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [t[k], "ю"], ["э"]])
        return "".join(t)

    texts = base + [edited(rng.choice(base), n) for n in (1, 2, 4, 6, 8, 10, 12, 20, 30) for _ in range(3)] + [base[3], "коротко", "коротка", "коротко", None]
    spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, object_type string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first, want = {}, {}
    for i, t in enumerate(texts):
        if t is None:
            continue
        if t in first:
            want[i] = first[t]
            continue
        if len(t) >= 100:
            scores = {j: 1 - _distance(t, u) / max(len(t), len(u)) for u, j in first.items() if len(u) >= 100}
            best = max(scores.values(), default=0)
            if best >= 0.95:
                want[i] = min(j for j, s in scores.items() if s == best)
        first[t] = i
    assert len(want) > 15
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["idx"]: r["canonical"] for r in run("D6_fuzzy_document_canonical")} == want
    groups = {}
    for i, c in sorted(want.items()):
        groups.setdefault(c, []).append(i)
    assert {r["canonical"]: r["members"] for r in run("D7_A13_fuzzy_document_clusters")} == {c: ",".join(map(str, [*m, c])) for c, m in groups.items()}
    repeats = {i for i, t in enumerate(texts) if t in texts[:i]}
    assert {r["a"] for r in run("D5_J15_fuzzy_document_edges")} == set(want) - repeats
