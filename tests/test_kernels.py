import math

import numpy as np
import pytest

from pointloom.functions import geometry as K


def test_peaks():
    assert K.peaks([0, 5, 0, 3, 3, 3, 0, 9], 1, 1, 1) == [1, 4]
    assert K.peaks([0, 5, 0, 3, 3, 3, 0, 9], 1, 1, 1, ends=True) == [1, 4, 7]
    assert K.peaks([0, 5, 4, 6, 0], 1, 0, 3) == [3]  # the higher one wins the distance
    assert K.peaks([0, 5, 4, 6, 0], 1, 2, 1) == [3]  # 5 rises only 1 above its saddle


def test_hull_and_area():
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.uniform(0, 1, (200, 2)), [[0, 0], [1, 0], [1, 1], [0, 1]]])
    assert len(K.hull(p)) == 4 and abs(K.area(K.hull(p)) - 1) < 1e-12
    assert abs(K.area(K.clipped(np.array([[0.5, 0.5], [2, 0.5], [2, 2], [0.5, 2]]), K.hull(p))) - 0.25) < 1e-12


def test_outlines_of_a_ring():
    cells = {(x, y) for x in range(6) for y in range(5)} - {(2, 2), (3, 2)}
    loops = K.outlines(cells)
    assert sorted(abs(K.area(q)) for q in loops) == [2, 30] and sum(K.area(q) for q in loops) == 28
    assert sorted(map(len, K.outlines({(0, 0), (1, 1)}))) == [4, 4]


def test_simplified_keeps_corners():
    line = [(x / 10, 0.001 * (x % 2)) for x in range(11)] + [(1, y / 10) for y in range(1, 11)]
    assert len(K.simplified(np.array(line), 0.01)) == 3


def test_assignment_against_permutations():
    from itertools import permutations

    from pointloom.operators.quality import assignment

    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        for _ in range(20):
            cost = rng.uniform(0, 1, (n, m))
            got = assignment(cost)
            assert len(got) == n and len({j for _, j in got}) == n
            assert abs(sum(cost[i, j] for i, j in got) - min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))) < 1e-9


@pytest.mark.parametrize("turn", [0.0, 0.63, 1.57])
def test_stair_lattice(turn):
    c, s = math.cos(turn), math.sin(turn)
    steps = [k for k in range(9) if k != 4]
    treads = [(0.28 * k * c + 3, 0.28 * k * s - 1, 0.17 * k, -s, c, 1.1) for k in steps] + [(9, 9, 0.5, -s, c, 1.1), (9.1, 9, 0.9, -s, c, 1.1)]
    (f,) = K.tread_sequences(np.array(treads))
    assert f["steps"] == 9 and f["missing"] == 1 and abs(f["rise"] - 0.17) < 1e-9 and abs(f["going"] - 0.28) < 1e-9
    assert K.tread_sequences(np.array(treads[:3])) == []
    assert K.tread_sequences(np.array([(*t[:3], c, s, 1.1) for t in treads])) == []  # treads that lie along the flight
    assert [len(f["members"]) for f in K.tread_sequences(np.array([(*t[:5], 1.1 if k != 2 else 2.0) for k, t in enumerate(treads)]))] == [7]  # one of another width


def test_two_flights_share_no_tread():
    up = [(0.28 * k, 0.0, 0.17 * k, 0, 1, 1.1) for k in range(8)]
    back = [(0.28 * (8 - k), 2.0, 0.17 * (8 + k), 0, 1, 1.1) for k in range(6)]
    found = K.tread_sequences(np.array(up + back))
    assert [f["steps"] for f in found] == [8, 6] and not set(found[0]["members"]) & set(found[1]["members"])
    far = [(0.28 * k, 0.0, 0.17 * k, 0, 1, 1.1) for k in (0, 1, 2, 3, 8, 9, 10, 11)]  # four missing in a row: two flights
    assert sorted(f["steps"] for f in K.tread_sequences(np.array(far))) == [4, 4]


def test_best_chain():
    zones = [(0.0, 0.3, 1.0), (1.4, 1.6, 0.9), (3.0, 3.3, 1.0), (6.1, 6.4, 1.0)]
    assert K.best_chain(zones, 2.0, 5.5) == [0, 2, 3] and K.best_chain([], 2.0, 5.5) == []
    assert K.best_chain([(0.0, 0.3, 1.0), (9.0, 9.3, 2.0)], 2.0, 5.5) == [1]  # too far apart: the better one alone


def test_best_chain_against_all_chains():
    from itertools import combinations

    rng = np.random.default_rng(6)
    for _ in range(60):
        bottom = rng.uniform(0, 14, 7)
        zones = [(b, b + t, s) for b, t, s in zip(bottom, rng.uniform(0.1, 0.5, 7), rng.uniform(0.2, 2, 7), strict=True)]

        def worth(chain):
            total = zones[chain[0]][2]
            for a, b in zip(chain, chain[1:], strict=False):
                step = zones[b][1] - zones[a][1]
                if zones[b][0] - zones[a][1] < 2 or step > 5.5:
                    return None
                total += zones[b][2] - 0.15 * abs(step - 3.2)
            return total

        order = sorted(range(7), key=lambda k: zones[k][1])
        every = [(w, c) for n in range(2, 8) for c in combinations(order, n) if (w := worth(c)) is not None]
        got = K.best_chain(zones, 2.0, 5.5)
        if every:
            assert len(got) >= 2 and abs(worth(tuple(got)) - max(every)[0]) < 1e-9
        else:
            assert got == [max(range(7), key=lambda k: zones[k][2])]


def test_paired_walls():
    border = np.array([(0, 0), (6, 0), (6, 4), (0, 4)], float)
    faces = [(0, 0, 6, 0), (0, 4, 6, 4), (0, 0, 0, 4), (6, 0, 6, 4), (2.9, 0, 2.9, 4), (3.1, 3, 3.1, 0)]
    walls = K.paired_walls(np.array(faces), (3, 2), border, (0.08, 0.6), 0.5, 0.2, 0.3, 0.06)
    (pair,) = [w for w in walls if w["label"] == "paired_faces"]
    assert abs(pair["thickness"] - 0.2) < 1e-9 and np.allclose([pair["start"][0], pair["end"][0]], 3.0) and abs(math.dist(pair["start"], pair["end"]) - 3) < 1e-9
    outside = [w for w in walls if w["label"] == "exterior_candidate"]
    assert len(outside) == 4 and all(min(w["start"].min(), 6 - w["start"][0], 4 - w["start"][1], w["end"].min()) < 0 for w in outside)
    (tail,) = [w for w in walls if w["label"] == "single_face_candidate"]  # what the longer face has left over
    assert abs(math.dist(tail["start"], tail["end"]) - 1) < 1e-9 and tail["start"][0] == 2.9


def test_regions_of_two_planes():
    g = np.array([(x * 0.05, y * 0.05, 0.0) for x in range(20) for y in range(20)] + [(0.0, y * 0.05, 0.1 + z * 0.05) for y in range(20) for z in range(20)])
    n = np.array([(0, 0, 1.0)] * 400 + [(1.0, 0, 0)] * 400)
    label = K.regions(g, n, np.zeros(800), 0.11, 15, 0.025, 30)
    assert len(set(label[:400])) == 1 and len(set(label[400:])) == 1 and label[0] != label[400]
