import numpy as np
import pytest

from semblance.operators.neighbors import BLOCK_ROWS, PIVOTS, _Block, _cell_count, _Tree, knn_join

CELLS = dict(broadcast_bytes=0, block_rows=100, pivots=40, hot_visits=50)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    p, q = np.round(rng.normal(size=(1500, 3)), 1), np.round(rng.normal(size=(300, 3)), 1)
    p[:500], q[:100] = p[0], q[0]
    pg, qg = rng.integers(0, 2, 1500), rng.integers(0, 2, 300)
    frame = lambda name, v, g: spark.createDataFrame(
        [(i, [float(x) for x in r], int(c)) for i, (r, c) in enumerate(zip(v, g))], f"{name} long, vec array<double>, g int")
    return p, q, pg, qg, frame("pid", p, pg), frame("qid", q, qg)


@pytest.mark.parametrize("by,alone,options", [(None, False, {}), ("g", True, {}), (None, False, CELLS), ("g", True, CELLS)])
def test_equals_brute_force(data, by, alone, options):
    p, q, pg, qg, points, queries = data
    want = set()
    for i in range(len(q)):
        d, ids = np.sqrt(np.cumsum((p - q[i]) ** 2, axis=1)[:, -1]), np.arange(len(p))
        ok = np.ones(len(p), bool) if by is None else pg == qg[i]
        if alone:
            ok &= ids != i
        o = np.lexsort((ids[ok], d[ok]))[:4]
        want |= {(i, r + 1, int(a), round(float(b), 9)) for r, (a, b) in enumerate(zip(ids[ok][o], d[ok][o]))}
    got = {(r.qid, r["rank"], r.pid, round(r.distance, 9)) for r in knn_join(queries, points, 4, by=by, exclude_self=alone, **options).collect()}
    assert got == want


@pytest.mark.parametrize("options", [{}, CELLS])
@pytest.mark.parametrize("shift,factor", [(0.0, 1e-6), (1e6, 1.0), (1e8, 1.0), (1.7e9, 1.0), (1.7e9, 1e6)])
def test_far_and_scaled_coordinates_equal_brute_force(spark, options, shift, factor):
    rng = np.random.default_rng(3)
    p, q = rng.normal(size=(1500, 3)) * factor + shift, rng.normal(size=(200, 3)) * factor + shift
    frame = lambda name, v: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"{name} long, vec array<double>")
    want = set()
    for i in range(len(q)):
        d = np.sqrt(np.cumsum((p - q[i]) ** 2, axis=1)[:, -1])
        want |= {(i, r + 1, int(a)) for r, a in enumerate(np.lexsort((np.arange(len(p)), d))[:3])}
    got = {(r.qid, r["rank"], r.pid) for r in knn_join(frame("qid", q), frame("pid", p), 3, **options).collect()}
    assert got == want


def test_a_wide_vector_is_sent_to_few_cells():
    assert _cell_count(100_000, 64, BLOCK_ROWS, PIVOTS) == 8
    assert _cell_count(600_000, 64, BLOCK_ROWS, PIVOTS) == 9
    assert _cell_count(30_000_000, 9, BLOCK_ROWS, PIVOTS) == 1831


@pytest.mark.parametrize("dims,size", [(3, 3000), (9, 3000), (64, 6000), (2, 5)])
@pytest.mark.parametrize("bounded", [False, True])
def test_block_search_equals_brute_force(dims, size, bounded):
    rng = np.random.default_rng(dims)
    p, q = np.round(rng.normal(size=(size, dims)), 1), np.round(rng.normal(size=(60, dims)), 1)
    q[:20], p[: size // 2, 0] = p[:20] if size > 20 else p[0], 0.0
    ids, k = rng.permutation(size), 7
    d = np.sqrt(np.cumsum((p[None] - q[:, None]) ** 2, axis=2)[:, :, -1])
    reach = np.quantile(d, 0.002, axis=1) if bounded else np.full(len(q), np.inf)
    want = []
    for i in range(len(q)):
        o = np.lexsort((ids, d[i]))[:k]
        want += [(i, ids[j], d[i, j]) for j in o if d[i, j] <= reach[i]]
    row, found, dist = _Block(p, ids).within(q, k, reach)
    got = [x for x in zip(row, found, dist) if x[2] <= reach[x[0]]]
    assert got == want and len(row) <= len(q) * k


@pytest.mark.parametrize("cells", [50, 400])
def test_a_query_of_few_dimensions_visits_few_cells(cells):
    rng = np.random.default_rng(7)
    p = np.column_stack([rng.normal(size=(20_000, 3)), rng.integers(0, 2, (20_000, 2))])
    tree = _Tree(p[:5000], cells)
    at = tree.place(p)
    n = np.bincount(at, minlength=tree.n_cells)
    tree.fit(n, np.array([p[at == c].min(axis=0) for c in range(len(n))]), np.array([p[at == c].max(axis=0) for c in range(len(n))]), 1)
    q = p[:300] + 0.01
    d = ((q[:, None] - p[None]) ** 2).sum(axis=2)
    row, cell = tree.visits(q, d.min(axis=1) * (1 + 1e-9))
    # every cell of a nearest point, and hardly any other
    assert {*enumerate(at[d.argmin(axis=1)])} <= {*zip(row, cell)}
    assert n.min() > 0 and n.max() < 4 * len(p) / cells and len(row) < 3 * len(q)
    # a bound before any search: as many points as asked for lie within
    assert (d.min(axis=1) <= tree.farthest(q, tree.place(q)) ** 2).all()


@pytest.mark.parametrize("values", [[0.0, np.nan, 1.0], [np.nan, np.nan, np.nan], [5.0, 5.0, 5.0], [np.inf, -np.inf, 0.0]])
def test_cells_of_odd_numbers_end(values):
    v = np.array([values, values[::-1], [1.0, 2.0, 3.0], [1.0, 2.0, 4.0]])
    tree = _Tree(v, 4)
    assert set(tree.place(v)) == set(range(tree.n_cells))
