import random
from fractions import Fraction

import pytest

from memlake.llm import mixing


def plain(weights, blocks):
    """Slot by slot: of the released blocks the one that is due first, of equals the first source's."""
    q, used, slots, t = sum(weights), [0] * len(weights), {}, 0
    while any(u < n for u, n in zip(used, blocks)):
        ready = [(-(-(u + 1) * q // w), i) for i, (w, n, u) in enumerate(zip(weights, blocks, used)) if u < n and u * q // w <= t]
        if ready:
            i = min(ready)[1]
            slots[i, used[i]] = t
            used[i] += 1
        t += 1
    return slots


@pytest.mark.parametrize("frame", [5, 64])
def test_frames_side_by_side_give_the_schedule_of_one_run(spark, frame):
    rng = random.Random(frame)
    for choices in ([3], [1, 2, 50], [7, 8, 9, 300], [20, 21, 997]):
        weights = [rng.choice(choices) for _ in range(rng.choice([1, 6, 30]))]
        blocks = [rng.randint(1, 12) for _ in weights]
        sizes = spark.createDataFrame([(f"={i:03d}", w, n) for i, (w, n) in enumerate(zip(weights, blocks))], "src string, w long, blocks long")
        rows = mixing.edf_schedule(sizes, frame).collect()
        assert {(int(r.src[1:]), r.block): r.slot for r in rows} == plain(weights, blocks) and len(rows) == sum(blocks)
        assert all(r.release <= r.slot < r.deadline for r in rows)


@pytest.mark.parametrize("weights", [{"a": 5, "b": 1}, {"a": 0.625, "b": 0.2, "c": 0.1, "d": 0.075}, {"a": Fraction(1, 3), "b": Fraction(1, 7)}])
def test_every_source_is_within_a_block_of_its_weight(spark, weights):
    """Against the weights as given, up to 100,000 slots."""
    total = sum(Fraction(str(v)) for v in weights.values())
    share = {k: Fraction(str(v)) / total for k, v in weights.items()}
    whole = mixing.whole_weights(weights)
    slots = 100_000
    sizes = spark.createDataFrame([("=" + k, w, int(slots * share[k])) for k, w in whole.items()], "src string, w long, blocks long")
    taken = sorted((r.slot, r.src[1:]) for r in mixing.edf_schedule(sizes, 1024).collect())
    assert len({t for t, _ in taken}) == len(taken)
    had = dict.fromkeys(share, 0)
    for t, k in taken:
        had[k] += 1
        if t % 97 == 0 or t > slots - 100:
            assert all(abs(had[x] - share[x] * (t + 1)) < 1 for x in share if had[x] < int(slots * share[x]))


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 1, "missing": 3}])
def test_mix_of_rows(spark, weights):
    sizes = {"a": 700, "b": 333, "c": 90, None: 41}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(n, s, "x", "y") for n, (_, s) in enumerate(rows)], "doc_id long, source string, slot string, doc string")
    out = mixing.scheduled(docs, weights=weights, block=4, ranked=100)
    got = out.collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == set(range(len(rows))) and out.columns == ["doc_id", "source", "doc", "block", "release", "deadline", "slot"]
    blocks = {(r.source, r.block): r.slot for r in got}
    assert len(set(blocks.values())) == len(blocks)
    for s, n in sizes.items():
        assert {b for x, b in blocks if x == s} == set(range(-(-n // 4)))
    if weights:
        last = max(t for (s, _), t in blocks.items() if s in ("a", "b"))
        assert all(r.slot > last and r.release is None for r in got if r.source not in ("a", "b"))
        want = plain([5, 1], [-(-700 // 4), -(-333 // 4)])
        assert {(0 if s == "a" else 1, b): t for (s, b), t in blocks.items() if s in ("a", "b")} == want


def test_weights():
    assert mixing.whole_weights({"a": 0.5, "b": 0.3, "c": 0}) == {"a": 5, "b": 3, "c": 0}
    for bad in ({"a": 0}, {"a": -1, "b": 2}, {"a": 1, "b": 1e-12}):
        with pytest.raises(ValueError):
            mixing.whole_weights(bad)
