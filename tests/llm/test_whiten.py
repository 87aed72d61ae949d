import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm.eigen import leading_pairs
from coppice.llm.whiten import Centre, whiten

SCHEMA = "vec_id long, embedding array<float>"
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def expected(vectors, k=32):
    """The contract again, with numpy's own eigenvectors."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    covariance = centred.T @ centred / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return x, ((n * x - total) ** 2).sum(axis=1), values, basis, centred, np.trace(covariance)


def matrices():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 7, 64):
        rows = rng.standard_normal((size * 30, size)) * 8
        yield rows.T @ rows / len(rows)
    yield np.eye(40) * 3
    yield np.zeros((5, 5))
    yield np.diag(np.arange(30.0))
    few = rng.standard_normal((6, 40))
    yield few.T @ few
    yield np.kron(np.eye(6), few[:, :6].T @ few[:, :6])
    yield np.ones((50, 50))
    glued = np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield from (glued, glued * 1e-200, glued * 1e150)


@pytest.mark.parametrize("matrix", list(matrices()), ids=lambda m: str(len(m)))
def test_leading_pairs(matrix):
    """Values, residuals and orthogonality, also where eigenvalues repeat or are zero."""
    k = min(32, len(matrix))
    values, basis = leading_pairs(matrix, 32)
    norm = max(np.abs(matrix).sum(axis=0).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:k]).max() < 1e-13 * norm
    assert np.abs(matrix @ basis - basis * values).max() < 1e-13 * norm
    assert np.abs(basis.T @ basis - np.eye(k)).max() < 1e-12


def test_against_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x, deviations, values, basis, centred, trace = expected([row.embedding for row in rows])
    out = whiten(spark.read.parquet(f"{sf}/embeddings.parquet")).toPandas()
    assert list(out.columns) == NAMES and len(out) == len(rows) * 32
    wide = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    reference = centred @ basis / np.sqrt(values)
    assert np.abs(wide - reference * np.sign((wide * reference).sum(axis=0))).max() < 1e-9
    first = out[out.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == deviations.tolist() and set(out.n) == {len(rows)}
    shares = out.drop_duplicates("component").sort_values("component").explained
    assert np.allclose(shares, values / trace, rtol=1e-12)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-10


def test_layout_does_not_matter(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    one, many = (whiten(table.repartition(n)).orderBy("vec_id", "component").toPandas() for n in (1, 7))
    assert np.abs(one.whitened - many.whitened).max() < 1e-9
    assert one.deviation.equals(many.deviation)


def test_odd_rows(spark):
    """What is dropped, what counts, fewer dimensions than components, clashing names."""
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.9]), (2, [0.5, -0.4]), (2, [0.5, -0.4]), (None, [0.3, 0.2]), (7, [-0.6, 0.0])]
    bad = [(3, None), (4, [nan, 0.0]), (5, [0.0, inf]), (6, [0.1, None]), (8, []), (9, [1.0]), (10, [1e30, 0.0])]
    table = spark.createDataFrame(good + bad, SCHEMA).repartition(3)
    clashing = ["n", "component", "whitened", "VEC_ID", "_id", "size"]
    out = whiten(table.select("*", *[F.lit("x").alias(name) for name in clashing])).toPandas()
    assert len(out) == 10 and set(out.n) == {5} and sorted(out.component.unique()) == [1, 2]
    _, deviations, values, _, _, trace = expected([vector for _, vector in good])
    assert sorted(out[out.component == 1].deviation) == sorted(deviations.tolist())
    assert np.allclose(out.groupby("component").explained.first(), values / trace)
    assert out.vec_id.isna().sum() == 2


def test_no_spread(spark):
    """Equal vectors have no directions; one direction leaves the other component null."""
    same = whiten(spark.createDataFrame([(i, [0.5, 0.25]) for i in range(4)], SCHEMA)).collect()
    assert all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in same) and len(same) == 8
    line = whiten(spark.createDataFrame([(i, [i / 64, 0.25]) for i in range(4)], SCHEMA)).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in line} == {(1, False, 1.0), (2, True, 0.0)}
    assert line[0].identity_error < 1e-12


def test_empty(spark):
    for rows in ([], [(1, None)]):
        out = whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == NAMES and out.collect() == []


def test_deviations_stay_exact():
    """Beyond 53 bits, and null beyond 64."""
    x = np.array([[1_000_000], [1_000_003], [1_000_000 + (1 << 30)]])
    total = int(x.sum()) * (1 << 20)
    n = 3 << 20
    assert Centre(n, [total]).deviations(x[:2]) == [v if v < 1 << 63 else None for v in ((n * int(a) - total) ** 2 for a in x[:2, 0])]
    assert Centre(n, [total]).deviations(x[2:]) == [None]
    total = int(x[:2].sum()) * (1 << 28)
    assert Centre(1 << 29, [total]).deviations(x[:2]) == [((1 << 29) * int(a) - total) ** 2 for a in x[:2, 0]]
