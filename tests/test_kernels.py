import numpy as np
import pytest

from arterial.operators import kernels as K


def line(n):
    return K.adjacency([(i, i + 1, 1.0) for i in range(n - 1)], range(n))


def grid(n):
    e = [(i * n + j, i * n + j + 1, 1.0) for i in range(n) for j in range(n - 1)] + [(i * n + j, i * n + n + j, 1.0) for i in range(n - 1) for j in range(n)]
    return K.adjacency(e, range(n * n))


def test_middle_of_a_line_is_most_between():
    bc = K.betweenness(line(5))
    assert max(bc, key=bc.get) == 2 and bc[2] == pytest.approx(4 * 2 / (4 * 3))


def test_cycle_and_star_betweenness():
    star = K.adjacency([(0, i, 1.0) for i in range(1, 6)])
    assert K.betweenness(star)[0] == pytest.approx(1.0)
    ring = K.adjacency([(i, (i + 1) % 6, 1.0) for i in range(6)])
    assert len({round(v, 9) for v in K.betweenness(ring).values()}) == 1


def test_efficiency_bounds_and_universe():
    full = K.efficiency(grid(4))
    assert 0 < full <= 1
    limb = K.adjacency([(a, b, w) for a in grid(4) for b, w in grid(4)[a].items() if a < b] + [(15, 16, 50.0), (16, 17, 50.0), (17, 18, 50.0), (18, 19, 50.0)])
    before = K.efficiency(limb)
    assert K.efficiency(K.without(limb, [16, 17, 18, 19]), 20) <= before
    assert K.efficiency(K.without(limb, list(limb)), 20) == 0


def test_cut_line_is_unreachable():
    assert K.path(line(5), 0, 4)[0] == 4.0
    assert K.path(K.without(line(5), [2]), 0, 4) == (K.INF, None)


def test_bridges_of_line_and_ring():
    assert K.bridges(line(4)) == [(0, 1), (1, 2), (2, 3)]
    assert K.bridges(K.adjacency([(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1)])) == [(2, 3)]


def test_line_mask_is_one_edge():
    m = np.zeros((21, 21)); m[10] = 1
    adj, xy = K.mask_graph(m)
    assert len(adj) == 2 and sum(len(r) for r in adj.values()) == 2
    assert abs(next(w for r in adj.values() for w in r.values()) - 20) <= 1


def test_plus_mask_has_a_crossing():
    m = np.zeros((21, 21)); m[10] = 1; m[:, 10] = 1
    adj, _ = K.mask_graph(m)
    assert sorted(len(r) for r in adj.values()) == [1, 1, 1, 1, 4]


def test_pixel_centres():
    m = np.zeros((10, 10)); m[5] = 1
    _, xy = K.mask_graph(m, (2, 0, 1000, 0, -2, 2000), 2.0)
    assert (1001.0, 1989.0) in {(x, y) for x, y in xy.values()}


def test_ring_and_empty_masks():
    m = np.zeros((12, 12)); m[2:9, 2] = m[2:9, 8] = 1; m[2, 2:9] = m[8, 2:9] = 1
    adj, _ = K.mask_graph(m)
    assert len(adj) >= 1
    assert K.mask_graph(np.zeros((5, 5))) == ({}, {})


def test_dissolve_keeps_the_shorter_of_parallel_edges():
    adj, _ = K.dissolve(K.adjacency([(0, 1, 5.0), (1, 2, 5.0), (0, 2, 3.0), (0, 3, 1.0), (2, 4, 1.0)]), {i: (i, 0) for i in range(5)})
    assert not [u for u in adj if len(adj[u]) == 2]


def test_dynamic_attack_is_no_milder_on_a_line():
    adj = line(9)
    assert K.attack(adj, 2, False)[0] == K.attack(adj, 2, True)[0] == 4
    assert K.efficiency(K.without(adj, K.attack(adj, 2, True)), 9) <= K.efficiency(K.without(adj, K.attack(adj, 2, False)), 9)


def test_segment_cover_is_wide_enough():
    m = K.segment_cover((20, 100), (1, 0, 0, 0, -1, 20), [(0, 10, 100, 10)], 2.0)
    assert m[:, 50].sum() >= 4 and m[0].sum() == 0
