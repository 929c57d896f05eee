import numpy as np
import pytest

from paperloom.operators.neighbours import neighbour_pairs, neighbours

SCHEMA = "path string, embedding array<float>, n long, node string, cell string, cluster string"


def frame(spark, vectors):
    rows = [(k, None if v is None else [float(x) for x in v], 1, "x", "x", "x") for k, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def crowded(seed, spread, lone, width=8):
    """A crowd around each of three centres, one of them most of all rows, repeats and scaled vectors among them."""
    rng = np.random.default_rng(seed)
    out = []
    for size in (150, 30, 10):
        centre = rng.normal(size=width)
        out += [centre + spread * rng.normal(size=width) for _ in range(size)]
    out += list(rng.normal(size=(lone, width)))
    out += [out[0]] * 40 + [2 * out[1], out[155], out[-1]]
    return [(f"d{i:03}", np.float32(v)) for i, v in enumerate(out)]


def brute_force(vectors, minimum):
    """Number of neighbours and cluster by document, and the linked pairs of different vectors."""
    names = [k for k, _ in vectors]
    m = np.array([v for _, v in vectors], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    alike = m @ m.T >= minimum - 1e-12
    np.fill_diagonal(alike, False)
    root = list(range(len(names)))
    for _ in names:
        root = [min([root[i], *[root[j] for j in np.flatnonzero(alike[i])]]) for i in range(len(names))]
    first = {}
    for k, v in sorted(vectors, key=lambda x: x[0]):
        first.setdefault(tuple(v), k)
    own = [first[tuple(v)] for _, v in vectors]
    pairs = {(own[i], own[j]) for i, j in zip(*np.nonzero(alike), strict=True) if own[i] < own[j]}
    return {k: (int(alike[i].sum()), names[root[i]]) for i, k in enumerate(names)}, pairs


@pytest.mark.parametrize(
    ("minimum", "spread", "pivots", "block_rows"), [(0.9, 0.2, 16, 2048), (0.97, 0.1, 5, 16), (0.5, 1.0, 40, 32), (1.0, 0.0, 7, 4)]
)
def test_neighbours_equal_brute_force(spark, minimum, spread, pivots, block_rows):
    vectors = crowded(pivots, spread, 40)
    want, links = brute_force(vectors, minimum)
    df = frame(spark, vectors)
    got = neighbours(df, minimum=minimum, pivots=pivots, block_rows=block_rows, hot_rows=20).collect()
    assert {r["path"]: (r["n_neighbours"], r["cluster"]) for r in got} == want and len(got) == len(want)
    pairs = neighbour_pairs(df, minimum=minimum, pivots=pivots, block_rows=block_rows).collect()
    assert {(r["source"], r["target"]) for r in pairs} == links and len(pairs) == len(links)


def test_pivots_keep_far_cells_apart(spark):
    """Crowds far from each other meet in no task."""
    from paperloom.operators import neighbours as module

    rows = [(f"d{i:03}", np.eye(4)[i % 4] + 0.001 * (i // 4)) for i in range(80)]
    classes = module._classes(frame(spark, rows), "path", "embedding")
    met = module._meetings(classes, 0.99, 80, 1000).collect()
    groups = {}
    for r in met:
        groups.setdefault((r["cell"], r["i"], r["j"]), set()).add(int(r["node"][1:]) % 4)
    assert all(len(g) == 1 for g in groups.values())


def test_odd_vectors(spark):
    odd = [None, [], [0, 0], [float("nan"), 1], [float("inf"), 1]]
    rows = [(f"o{i}", v) for i, v in enumerate(odd)] + [("a", [1, 0]), ("b", [3e30, 1e-30]), (None, [1, 0]), ("c", [0, 1])]
    got = {r["path"]: (r["n_neighbours"], r["cluster"]) for r in neighbours(frame(spark, rows), minimum=0.9).collect()}
    want = {f"o{i}": (0, f"o{i}") for i in range(len(odd))}
    assert got == want | {None: (0, None), "a": (1, "a"), "b": (1, "a"), "c": (0, "c")}
    for empty in ([], [("o", [0, 0])]):
        assert [tuple(r) for r in neighbours(frame(spark, empty)).collect()] == [(k, 0, k) for k, _ in empty]
        assert neighbour_pairs(frame(spark, empty)).collect() == []


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="differ in length"):
        neighbours(frame(spark, [("a", [1, 0]), ("b", [1, 0, 0])])).collect()


def test_visits_leave_a_task_in_bounded_batches():
    """A row that visits all cells is not gathered with all other rows of its batch."""
    import pyarrow as pa

    from paperloom.operators import neighbours as module

    class Rows:  # what `_visits` asks of a DataFrame, to see the batches that a task hands on
        schema = {"node": type("Field", (), {"dataType": type("Type", (), {"simpleString": lambda self: "long"})()})()}

        def select(self, *_):
            return self

        def mapInArrow(self, run, ddl):
            return run

    rng = np.random.default_rng(2)
    unit = lambda n: module._unit(rng.normal(size=(n, 64)))
    pivots, rows = unit(128), unit(3000)
    vectors = pa.array(list(rows), pa.list_(pa.float64()))
    cells = pa.array(np.argmin(2 - 2 * rows @ pivots.T, 1), pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([1] * 3000), vectors, cells], ["node", "n", "vector", "cell"])
    rings = np.array([[0.0] * 128, [2.0] * 128])
    out = list(module._visits(Rows(), pivots, rings, 1.1)(iter([batch])))
    visits = sorted((n, c) for b in out for n, c in zip(b.column("node").to_pylist(), b.column("cell").to_pylist(), strict=True))
    own = cells.to_numpy()
    assert visits == [(n, c) for n in range(3000) for c in range(own[n] + 1, 128)]  # all later cells: nothing rules one out
    assert max(b.num_rows for b in out) * 64 <= module.VISIT_VALUES < len(visits) * 64
    flat = [v for b in out for v in zip(b.column("node").to_pylist(), b.column("vector").to_pylist())][:200]
    assert all(np.array_equal(rows[n], v) for n, v in flat)
