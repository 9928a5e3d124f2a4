"""Paths that small data do not take by themselves: large graphs, clusters without a shared folder, staged tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import documents, entities
from spanloom.plans import fuzzy
from spanloom.plans.components import components
from spanloom.plans.skew import lookup_join


def test_components_by_one_task_and_in_rounds(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(None, 1), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, rounds = (sorted(map(tuple, components(df, n).collect())) for n in (10**6, 0))
    assert one == rounds and len(dict(one)) == len(one) > 200
    assert components(df.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        """No checkpoint folder, set in neither place; a master that is not local."""

        master = "spark://host:7077"

        def get(self, name, default=None):
            return default

        def isDefined(self):
            return False

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

    none = Nothing()
    none.conf = none.sparkContext = none._jsc = none
    with pytest.raises(session.NoSharedFolder):
        session.work_dir(none)


def test_staged_tables_end_with_their_scope(spark):
    with session.scope(spark):
        t = session.stage(spark.range(3).toDF("x"))
        at = t._staged_at
        assert t.count() == 3 and os.path.isdir(at)
    assert not os.path.isdir(at)


def test_a_listing_is_pruned(spark, tmp_path):
    doc = "id long, object_type string, system_id string, root_id long, is_active boolean, created_at timestamp, updated_at timestamp, text string, ner_text string"
    spark.createDataFrame([(1, "a", "1", None, True, None, None, "x", "y"), (1, "a", "1", None, True, None, None, "z", "y"), (None,) * 9], doc).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    listed = documents.current(docs, "id", "object_type")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and [tuple(r) for r in listed.collect()] == [(1, "a")]
    whole = [documents.current(d).collect() for d in (docs, docs.orderBy("text"), docs.orderBy(F.desc("text")))]
    assert whole[0] == whole[1] == whole[2] and len(whole[0]) == 1


def test_classes_do_not_hang_on_partitions(spark):
    rows = [(k % 3, "go sql", [(0, 2, "A" if k else "B"), (3, 6, "C")]) for k in range(12)] + [(None, "go", [(0, 2, "Z")]), (None, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, entities array<struct<start:int,`end`:int,class:string>>")
    got = [sorted(map(str, entities.with_majority_class(df.repartition(n)).collect())) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def _fuzzy_brute(texts, cutoff, least):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    out, firsts = set(), {}
    for i, t in enumerate(texts):
        firsts.setdefault(t, i)
    seen = {}
    for t, i in sorted(firsts.items(), key=lambda x: x[1]):
        if len(t) < least:
            continue
        low = t.lower()
        if low in seen:
            out.add((i, seen[low], 1.0))
            continue
        scores = {j: 1 - distance(low, other) / max(len(low), len(other)) for other, j in seen.items()}
        best = max(scores.values(), default=0)
        out |= {(i, j, round(s, 9)) for j, s in scores.items() if s == best and s >= cutoff}
        seen[low] = i
    return out


@pytest.mark.parametrize("cutoff,least,size,edits", [(0.85, 5, 14, 3), (0.95, 100, 120, 9)])
def test_no_close_text_is_missed(spark, cutoff, least, size, edits):
    rng, letters, texts = random.Random(7), "абвгдежзиklmn ", []
    for _ in range(25):
        base = [rng.choice(letters) for _ in range(size)]
        texts.append("".join(base))
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randrange(0, edits)):
                k = rng.randrange(len(t))
                t[k : k + rng.randrange(0, 2)] = [rng.choice(letters)] * rng.randrange(0, 2)
            texts.append("".join(t).upper() if rng.random() < 0.1 else "".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    got = {(r["a"], r["b"], r["weight"]) for r in fuzzy.edges(df, cutoff, least).collect()}
    assert got == _fuzzy_brute(texts, cutoff, least) and len(got) > 20


def test_lookups_of_heavy_keys(spark):
    df = spark.createDataFrame([(7, i) for i in range(500)] + [(k, k) for k in range(6)] + [(None, 1)], "k int, v int")
    table = spark.createDataFrame([(7, "hot"), (1, "one")], "k int, name string")
    for hot in (None, [7], []):
        got = lookup_join(df, table, "k", hot=hot)
        assert got.count() == 507 and got.where("name = 'hot'").count() == 500
