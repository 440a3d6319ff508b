"""The ordered assignment as arrays, and what is left out before it."""

import random

import numpy as np

from webobs.operators import interval
from webobs.operators.interval import assign_pass

KINDS = "vp long, ip long, everywhere boolean, often boolean"


def drawn(r, blocks):
    d = {}
    for b in range(blocks):
        for _ in range(r.randint(1, 25)):
            e, o = r.random() < 0.5, r.random() < 0.8
            if e or o:
                d[(100 * b + r.randint(0, 9), 100 * b + r.randint(0, 9))] = (e, o)
    return [(*k, *f) for k, f in d.items()]


def test_arrays_equal_the_plain_pass():
    r = random.Random(1)
    for _ in range(300):
        if c := drawn(r, 2):
            v, i = interval.assign_codes(*map(np.array, zip(*c)))
            assert sorted(zip(v.tolist(), i.tolist())) == assign_pass(c)


def test_assignment_with_and_without_what_is_left_out(spark):
    c = drawn(random.Random(2), 40)
    odd = [(None, 1, True, True), (1, None, True, True), *c[:5]]
    for rounds in (30, 1):
        got = interval.assign(spark.createDataFrame(c + odd, KINDS), "vp", "ip", rounds)
        assert sorted(map(tuple, got.collect())) == assign_pass(c)


def test_sets_that_never_come_down_to_one_address_reach_no_task(spark):
    c = [(v, i, i < 3, True) for v in range(50) for i in range(100)] + [(99, 0, True, True), (98, 0, True, True), (98, 1, True, True)]
    left = interval._may_act(spark.createDataFrame(c, KINDS), "vp", "ip", 30)
    want = {(v, i, True, False) for v in range(50) for i in range(3)} | {(99, 0, True, True), (98, 0, True, True), (98, 1, True, True)}
    assert set(map(tuple, left.collect())) == want  # 5,003 rows before
    d = [r for r in c if r[0] < 50]
    assert not interval._may_act(spark.createDataFrame(d, KINDS), "vp", "ip", 30).collect() and not assign_pass(d)
