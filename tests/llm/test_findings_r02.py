"""Cases of the findings of round 2 on the training-data operators."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import history, lookalike


def test_unlike_classes_of_a_bucket_do_not_come_out_of_the_join(spark):
    rng = random.Random(1)
    bits = lambda: (rng.getrandbits(63), rng.getrandbits(63))
    near = bits()
    mine = [(1, (1, 1), 7, *near), (2, (1, 2), 7, near[0] ^ 7, near[1] ^ 1), *[(k, (1, k), 7, *bits()) for k in range(10, 60)]]
    past = [(-1, 7, near[0], near[1] ^ 3), *[(-k, 7, *bits()) for k in range(10, 60)]]
    mine = spark.createDataFrame(mine, "fp long, place struct<batch_no:long,id:long>, key long, s0 long, s1 long")
    past = spark.createDataFrame(past, "other long, key long, s0_other long, s1_other long")
    want = {(1, 2), (1, -1), (2, -1)}
    met = {tuple(r) for r in history.meet(mine, past, None).collect()}
    assert want <= met and len(met) < 30  # of 3,900 pairs in the bucket
    crowds = history.crowded(mine.select("fp", "key"), 10)
    assert len(history.meet(mine, past, crowds).collect()) < 10


def test_one_task_decides_as_rounds_do(spark):
    rng = random.Random(2)
    leaders = spark.createDataFrame([(k, (1, k), k % 17 == 0) for k in range(300)], "fp long, place struct<batch_no:long,id:long>, known boolean")
    edges = [(k, rng.randrange(k)) for k in range(1, 300) if k % 3 for _ in range(2)] + [(k, k - 1) for k in range(100, 200)]
    edges = spark.createDataFrame(edges, "fp long, earlier long").distinct()
    one, rounds = (sorted(map(tuple, history.resolve(leaders, edges, n).collect())) for n in (10**6, 0))
    assert [r for r in one if r[1]] == [r for r in rounds if r[1]] and len(one) == 300
    assert [tuple(r) for r in history.resolve(leaders, edges.limit(0)).where("accepted").orderBy("fp").collect()] == [(k, True) for k in range(300) if k % 17]
    assert 50 < sum(r[1] for r in one) < 280 and leaders.where(F.col("known")).count() == 18


def test_a_session_without_look_alikes_is_an_error(spark):
    class Package:
        """A name that the gateway finds no class for."""

        def __getattr__(self, name):
            return Package()

        def __call__(self, *args):
            raise TypeError("'JavaPackage' object is not callable")

    class Session:
        _jvm = Package()

    with pytest.raises(lookalike.NoConfusables):
        lookalike.published(Session())
    assert len(lookalike.published(spark)) > 1000


def test_models_come_from_all_documents(spark):
    """a word of any three documents, labelled or not, is in the models, however the documents are parted."""
    from spanloom.llm import subjects

    groups = 4300
    docs = [(i, f"w{i // 3} tail") for i in range(3 * groups)]
    labels = [(i, "xy"[i % 2]) for i in range(8300)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    made = [subjects.fit(x, lab) for x in (d, d.repartition(5))]
    # The unknown word, the words, the pairs at a start and within.
    assert [m.table.shape for m, _ in made] == [(1 + groups + 1 + 2 * groups, 3)] * 2
    assert (made[0][0].table == made[1][0].table).all() and made[0][0].margin == made[1][0].margin
