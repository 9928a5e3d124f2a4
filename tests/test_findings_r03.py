"""Cases of the findings of round 3."""

import random
import re

import pytest

from spanloom.operators import extract


def _brute(text: str, known: dict[str, str]) -> list[tuple[int, int, str]]:
    """Longest first from the left; the texts here are one sentence each."""
    tok, out, at = [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)], [], 0
    for i, (start, _) in enumerate(tok):
        ends = [end for _, end in tok[i:] if text[start:end].lower() in known]
        if start >= at and ends:
            at = max(ends)
            out.append((start, at, known[text[start:at].lower()]))
    return out


@pytest.mark.parametrize("buckets", [21, 8, 1])
def test_runs_of_a_large_dictionary_are_not_shuffled(spark, monkeypatch, buckets):
    """of a dictionary too large to be sent only runs that are keywords, and few others, are written and met by value."""
    rng = random.Random(6)
    words = ["".join(rng.choice("абвгkm") for _ in range(3)) for _ in range(60)]
    some = lambda n: rng.choice([" ", " ", "-"]).join(rng.choice(words) for _ in range(n))
    known = {some(rng.choice([1, 2, 2, 3, 7])): rng.choice("TS") for _ in range(25)} | {"οδοσ'αβ": "T", "οδος": "S", "zi̇s a": "T"}
    texts = [" ".join(rng.choice([some(2).title(), some(5), rng.choice(list(known)).upper()]) for _ in range(20)) for _ in range(30)] + ["ΟΔΟΣ'ΑΒ ΟΔΟΣ zİs A", "ΟΔΟΣ' x"]
    df = spark.createDataFrame([*enumerate(texts), (98, ""), (99, None)], "id long, text string")
    kw = spark.createDataFrame([*((k, v, t) for k, (v, t) in enumerate(known.items())), (98, None, "T"), (99, "", "T")], "id long, value string, type string")
    met, join = [], extract.lookup_join
    monkeypatch.setattr(extract, "SENT", 0)
    monkeypatch.setattr(extract, "BUCKETS", buckets, raising=False)
    monkeypatch.setattr(extract, "lookup_join", lambda runs, *a: met.append(runs) or join(runs, *a))
    got = {r["id"]: [tuple(e) for e in r["entities"]] for r in extract.extract_by_dictionary(df, kw).collect()}
    assert got == {k: _brute(t, known) for k, t in enumerate(texts)} | {98: [], 99: []} and sum(map(len, got.values())) > 150
    values = [r["value"] for m in met for r in m.collect()]
    assert len(met) == 1 and sum(v in known for v in values) > 150
    if buckets == 21:
        assert set(values) <= set(known)
