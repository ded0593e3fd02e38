"""Mixing: the schedule against the fluid shares, and the layout against a plain computation."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattline.llm.mixing import GRID, Phase, mixed, on_grid, pfair, phases, schedule_mix


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.tuples(st.integers(1, 40), st.integers(1, 30)), min_size=1))
def test_every_block_once_within_less_than_one_block(sources):
    blocks = {s: n for s, (n, _) in sources.items()}
    weights = {s: Fraction(w, 7) for s, (_, w) in sources.items()}
    out = pfair(blocks, weights)
    assert sorted((s, k) for s, k, *_ in out) == sorted((s, k) for s, n in blocks.items() for k in range(n))
    assert all(r <= t < d for t, (_, _, r, d) in enumerate(out))
    left, start, had = dict(blocks), 0, dict.fromkeys(blocks, 0)
    active = set(blocks)
    for t, (s, k, *_) in enumerate(out):
        assert k == blocks[s] - left[s]
        left[s] -= 1
        had[s] += 1
        whole = sum(weights[x] for x in active)
        assert all(abs(had[x] - weights[x] / whole * (t + 1 - start)) < 1 for x in active)
        if not left[s]:
            active = {x for x in active if left[x]}
            start, had = t + 1, dict.fromkeys(blocks, 0)


def test_positions(spark):
    rows = [(i, "x" * (i % 50), "hot" if i % 3 else f"s{i % 5}", 7) for i in range(400)] + [(900, None, None, 1), (901, "y" * 5000, "s1", 1), (None, "z", "s2", 1), (3, "xxx", "s3", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int").repartition(5)
    out = sorted(schedule_mix(docs, weights={"hot": 0.5, "s1": 0.1, "s2": 0.1, "s3": 0.1, "s4": 0.1, "s0": 0.05, None: 0.05}, block_bytes=200).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in out] == list(range(len(rows)))
    assert sorted((r["doc_id"] or -1, r["source"] or "") for r in out) == sorted((r[0] or -1, r[2] or "") for r in rows)
    assert [r["slot"] for r in out] == sorted(r["slot"] for r in out)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    for slot in {r["slot"] for r in out}:
        inside = [r for r in out if r["slot"] == slot]
        assert len({(r["source"], r["block"]) for r in inside}) == 1
        assert sum(r["size"] for r in inside) - max(r["size"] for r in inside) <= 200
    laid = [r["doc_id"] for r in mixed(docs, block_bytes=200).select("doc_id").collect()]
    assert len(laid) == len(rows) and mixed(docs).columns == docs.columns
    again = sorted(schedule_mix(docs, block_bytes=200).collect(), key=lambda r: r["position"])
    first = list(dict.fromkeys(r["doc_id"] for r in again))
    assert list(dict.fromkeys(laid)) == first


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert schedule_mix(none).count() == 0 and mixed(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 9), st.tuples(st.integers(1, 90), st.floats(0.02, 9)), min_size=1, max_size=6), st.sampled_from([1, 2, 7, 32, 50]))
def test_phases_keep_every_block_in_its_window(sources, period):
    """Periods worked out on their own make one schedule: every block once, in its window for the weights as given, source after source running out."""
    blocks, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    left, at = dict(blocks), 0
    for part in phases(blocks, weights, period):
        assert part.start == at and part.sources == sorted(left)
        exact = [Fraction(weights[s]) / sum(Fraction(weights[x]) for x in left) for s in part.sources]
        assert all(abs(Fraction(p, 1 << GRID) - w) < Fraction(2, 1 << GRID) for p, w in zip(part.parts, exact))
        plan, had, t = Phase(part.parts, period), [0] * len(exact), 0
        assert plan.period == part.period >= max(period, 1 / min(exact) - 1)
        assert part.before == [blocks[s] - left[s] for s in part.sources]
        for k in range(-(-part.slots // plan.period)):
            for t, s, i, r, d in plan.slots(k):
                if t >= part.slots:
                    break
                assert i == had[s] and r <= t < d and (r, d) == (plan.release(s, i + 1), plan.deadline(s, i + 1))
                had[s] += 1
                assert all(abs(n - w * (t + 1)) < 1 + Fraction(1, 1 << 40) for n, w in zip(had, exact))
        at += part.slots
        for s, n in zip(part.sources, had):
            left[s] -= n
            assert left[s] >= 0
        assert sum(n == 0 for n in left.values()) == 1
        left = {s: n for s, n in left.items() if n}
    assert not left and at == sum(blocks.values())


@pytest.mark.parametrize("weights", [[1.0, 2.0], [1e-6, 1.0], [0.1, 0.2, 0.7], [1e-5, 3e-5, 0.5, 0.25, 1 / 3], [7.0**0.5, 11.0**0.5, 1e-3, 456.789], [1.0] * 7, [2.0**-k for k in range(1, 15)]])
def test_no_drift_over_a_million_slots(weights):
    """At borders of periods far out, counts are within less than one block of the targets, and the periods around them hold all windows."""
    plan = Phase(on_grid(weights), 4096)
    exact = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    size = plan.period
    for k in (1, 2, 17, 100, 243, 244, 1 << 18, 1 << 20):
        t = k * size
        ahead = plan.done(t).tolist()
        assert sum(ahead) == t and all(abs(n - w * t) < 1 + Fraction(1, 1 << 20) for n, w in zip(ahead, exact))
    for k in (0, 1, 1 << 18) if size == 4096 else (7,):
        had = plan.done(k * size).tolist()
        for n, (t, s, i, r, d) in enumerate(plan.slots(k)):
            assert t == k * size + n and i == had[s] and r <= t < d
            had[s] += 1
        assert had == plan.done((k + 1) * size).tolist()


def test_many_sources_have_room():
    rng = np.random.default_rng(4)
    weights = (rng.pareto(1.0, 200) + 1e-3).tolist()
    plan = Phase(on_grid(weights), 512)
    for k in (1, 5, 60):
        assert [t for t, *_ in plan.slots(k)] == list(range(k * plan.period, (k + 1) * plan.period))
        assert all(r <= t < d for t, _, _, r, d in plan.slots(k))


def test_a_phase_without_end_is_pfair():
    """Against the plain schedule where no block is held back by a border."""
    share = {0: Fraction(1, 2), 1: Fraction(1, 4), 2: Fraction(1, 4)}
    plan = Phase(on_grid([2.0, 1.0, 1.0]), 4)
    got = [(s, i) for k in range(10) for _, s, i, _, _ in plan.slots(k)]
    want = [(s, i) for s, i, *_ in pfair({0: 21, 1: 21, 2: 21}, share)][:40]
    assert got == want


def test_a_million_slots_of_unequal_sources():
    """Weights of one and two: after 10^6 slots the first has a third, to a block; of 10^-6 and one, the small one has one block."""
    for weights, slots in (([1.0, 2.0], 1_000_000), ([1e-6, 1.0], 1_000_000)):
        plan, had = Phase(on_grid(weights), 4096), [0, 0]
        k = slots // plan.period
        had = plan.done(k * plan.period).tolist()
        for t, s, *_ in plan.slots(k):
            if t < slots:
                had[s] += 1
        assert all(abs(n - slots * w / sum(weights)) < 1 for n, w in zip(had, weights))


def test_many_sources_and_a_long_document(spark):
    """Sources beyond the bound share their sum by their own weights; a document over several blocks is charged them all."""
    rows = [(i, "x" * 99, f"s{i % 30}") for i in range(900)] + [(5000, "y" * 100_000, "big"), *((6000 + i, "z" * 99, "big") for i in range(50)), (None, None, None)]
    rows += [(7000 + i, "x" * 99, "s29") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = schedule_mix(docs, weights={"big": 1.0, "s0": 1.0}, block_bytes=1000, most_sources=5).collect()
    assert sorted(r["position"] for r in out) == list(range(len(rows)))
    long = next(r for r in out if r["doc_id"] == 5000)
    own = {r["block"] for r in out if r["source"] == "big" and r["doc_id"] != 5000}
    assert not own & set(range(long["block"] + 1, long["block"] + 100))
    at = {}
    for r in out:
        at.setdefault((r["source"], r["block"]), set()).add(r["slot"])
    assert all(len(x) == 1 for x in at.values()) and len(set().union(*at.values())) == len(at)
    # The pooled sources: blocks in the order of block number over weight.
    pooled = sorted((next(iter(x)), b, s) for (s, b), x in at.items() if s not in {"big", "s0", "s29"} and s is not None)
    chosen = {r["source"] for r in out} - {s for _, _, s in pooled}
    assert len(chosen) <= 6
    for s in {s for _, _, s in pooled}:
        mine = [b for _, b, x in pooled if x == s]
        assert mine == sorted(mine)
    equal = [b for _, b, s in pooled if s in {f"s{k}" for k in range(10, 20)}]
    assert equal == sorted(equal)  # sources of one size go round in turn


def test_names_of_columns_do_not_matter(spark):
    rows = [(i, f"t{i}", f"s{i % 3}", 1, 2, 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position int, _key int, place_key int")
    assert sorted(map(tuple, mixed(docs, block_bytes=8).collect())) == sorted(rows)
