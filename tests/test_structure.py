"""Components of tag sequences without a list of all links."""

import random
from collections import defaultdict

import numpy as np
import pytest

from webobs.operators import similarity
from webobs.operators.similarity import sequence_ratio


def drawn(r, n, sizes):
    """Sequences near one another: a few are drawn, the others are changed copies of any before."""
    out = []
    for _ in range(n):
        if not out or r.random() < 0.2:
            out.append([r.choice("abcde") for _ in range(r.choice(sizes))])
        else:
            s = list(r.choice(out))
            for _ in range(r.randint(1, 3)):
                s.insert(r.randint(0, len(s)), r.choice("abcde"))
            out.append(s)
    return out


def parts(seqs, least=0.8):
    """Smallest id of each sequence's component, over all pairs; of equal ones the first stands for all."""
    first = {}
    for i, s in enumerate(seqs):
        first.setdefault(tuple(s), i)
    ids = sorted(first.values())
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sequence_ratio(seqs[i], seqs[j]) >= least:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(first[tuple(s)]) for i, s in enumerate(seqs)}


def test_few_links_join_what_all_links_join():
    """One link less than members for each component; two sides leave pairs inside a side alone."""
    r = random.Random(3)
    for sizes in ((17, 20, 26), (60, 64, 70), (120, 254, 255, 256)):
        seqs = [list(x) for x in dict.fromkeys(map(tuple, drawn(r, 60, sizes)))]
        want = parts(seqs)
        codes = [np.array(["abcde".index(x) for x in s], "u1") for s in seqs]
        ids, one = list(range(len(seqs))), np.zeros(len(seqs), int)
        links = list(similarity._joined(ids, codes, np.arange(len(seqs)), one, 0.8, 7, 11))
        assert len(links) == len(seqs) - len(set(want.values())) and links
        assert all(a < b and want[a] == want[b] and sequence_ratio(seqs[a], seqs[b]) >= 0.8 for a, b in links)
        side = np.arange(len(seqs)) % 2
        assert all((a + b) % 2 for a, b in similarity._joined(ids, codes, np.arange(len(seqs)), side, 0.8, 7, 11))


@pytest.mark.parametrize("first,block", [(8_000, 3_000), (60, 40)])
def test_components_equal_brute_force(spark, first, block):
    seqs = drawn(random.Random(4), 150, (5, 17, 20, 30))
    docs = spark.createDataFrame(list(enumerate(seqs)), "id long, tags array<string>")
    want = parts(seqs)
    got = dict(map(tuple, similarity.tag_components(docs, "id", "tags", 0.8, first, block).collect()))
    assert got and all(want[i] == c for i, c in got.items())
    assert {i for i, c in want.items() if i != c and seqs.index(seqs[i]) == i} <= set(got)
    assert dict(map(tuple, similarity.structure_groups(docs, "id", "tags").collect())) == want


def test_groups_list_no_links(spark, monkeypatch):
    """A hundred sequences within one change of one another have thousands of links; the components need none of the lists."""
    base = [c for c in "abcde" * 6]
    seqs = [base[:k] + [x] + base[k:] for k in range(0, 30, 2) for x in "abcde"] + [base]
    monkeypatch.setattr(similarity, "tag_links", lambda *a: pytest.fail("a list of all links"))
    docs = spark.createDataFrame(list(enumerate(seqs)), "id long, tags array<string>")
    got = defaultdict(set)
    for i, c in similarity.structure_groups(docs, "id", "tags").collect():
        got[c].add(i)
    assert dict(got) == {0: set(range(len(seqs)))}
