"""Hard negatives against SQL and brute force."""

import numpy as np
import pytest

from tillroll.llm import hard_negatives as hn
from tillroll.llm import topk


def brute(rows, every, positives, k, low=50, high=95):
    out = []
    for aid, alabel, a in (r for r in rows if r[0] % every == 0):
        scored = sorted(((-int(np.dot(a, v)), i, label) for i, label, v in rows if i != aid))
        own = [(i, -s) for s, i, label in scored if label == alabel][:positives]
        for pid, ps in own:
            fit = [(i, -s) for s, i, label in scored if label != alabel and low * ps <= 100 * -s <= high * ps][:k]
            out += [(aid, pid, rank + 1, i, ps, s) for rank, (i, s) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    df = spark.createDataFrame([(i, label, [float(x) for x in v]) for i, label, v in rows], "id long, label int, v array<double>")
    return hn.usable_rows(df, "id", "label", "v")


@pytest.mark.parametrize("hot", [0, 100])
def test_small_tiles_ties_and_hot_label(spark, monkeypatch, hot):
    """Many equal scores, several blocks a label, a third of the rows alike in
    label and vector."""
    for name, value in (("BLOCK_ANCHORS", 7), ("BLOCK_ROWS", 40), ("SLICE", 4)):
        monkeypatch.setattr(hn, name, value)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    r = np.random.default_rng(hot)
    rows = [(i, int(r.integers(0, 4)), r.integers(-3, 6, 5)) for i in range(300)]
    rows = [(i, 1, np.array([4, 1, 2, 0, 1])) if i < hot else (i, label, v) for i, label, v in rows]
    df = frame(spark, rows)
    got = hn.hard_negatives(df.where("id % 6 = 0"), df, 5, 3)
    want = brute(rows, 6, 5, 3)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_full_slots_are_bounded_before_sorting():
    r = np.random.default_rng(5)
    score, ids = r.integers(0, 40, (20, 200)), np.arange(200) * 3
    limits = np.sort(r.integers(5, 45, (20, 4)), axis=1)
    limits[3, 2:] = hn.NO_LIMIT
    top = np.where(limits < hn.NO_LIMIT, limits, -1).max(axis=1)
    for share in (0.05, 1.0):                # few allowed scores, and nearly all of them
        allowed = (r.random(score.shape) < share) & (score <= top[:, None])
        got = list(zip(*hn.first_of_slots(score, allowed, limits, ids, 3)))
        want = []
        for row in range(20):
            for slot, upper in enumerate(limits[row]):
                lower = limits[row][slot - 1] if slot else -1
                inside = sorted((-score[row, c], c) for c in range(200) if allowed[row, c] and lower < score[row, c] <= upper)
                want += [(row, slot, c) for _, c in inside[:3] if upper < hn.NO_LIMIT]
        assert sorted(got) == sorted(want)


def test_awkward_rows_take_no_part(spark):
    rows = [(0, 1, [4.0, 0.0]), (0, 2, [9.0, 9.0]), (1, 1, [4.0, 0.0]), (2, 2, [3.0, 1.0]), (3, None, [3.0, 1.0]), (4, 2, None),
            (5, 2, [3.0, None]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (None, 2, [3.0, 1.0]), (8, 2, []),
            (9, 2, [3.0, 1.0, 7.0]), (10, 2, [3.0, 1.0]), (10, 2, [3.0, 1.0]), (11, 3, [-9.0, 0.0]), (12, 3, [-9.0, 0.0])]
    df = hn.usable_rows(spark.createDataFrame([r + ("x", 1) for r in rows], "id long, label int, v array<float>, d string, rank int"),
                        "id", "label", "v")
    got = sorted(map(tuple, hn.hard_negatives(df.where("id in (0, 9, 11)"), df).collect()))
    # id 0 keeps its smaller (label, vector); the anchor 9 has no partner of its length
    assert got == [(0, 1, 1, 2, 16, 12), (0, 1, 2, 10, 16, 12)]
    none = df.limit(0)
    assert hn.hard_negatives(none, none).collect() == [] and hn.hard_negatives(df.where("id = 9"), df).collect() == []


def test_limits_are_exact(spark):
    scores = [0, 1, -1, 99, 101, 2 ** 62 + 1, -(2 ** 62) - 1]
    import pyspark.sql.functions as F
    df = spark.createDataFrame([(s,) for s in scores], "s long")
    got = df.select("s", hn.limit(F.col("s"), 95, F.floor), hn.limit(F.col("s"), 50, F.ceil)).collect()
    assert {tuple(r) for r in got} == {(s, 95 * s // 100, -(-50 * s // 100)) for s in scores}
