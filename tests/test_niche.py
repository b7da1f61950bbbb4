"""The neural refinement: gradients by differences, exchange, training and prediction in blocks."""

import numpy as np

from tissuequery.operators import niche


def data(n=12, side=8, p=3, clusters=2):
    rng = np.random.default_rng(5)
    return rng.normal(size=(n, p)), rng.normal(size=n), rng.uniform(0.1, 1, (n, side, side)), rng.integers(0, 5, (n, clusters)).astype(float)


def test_gradients_equal_differences():
    x, y, maps, counts = data(6)
    rng = np.random.default_rng(1)
    for activation in niche.ACTIVATIONS:
        w = niche.initial(np.array([0.5, 1.0, -0.7, 0.3]), 2, 3)

        def loss(v):
            b = niche.forward(v, maps, counts, activation, training=True)[0]
            return float(((b[:, 0] + (b[:, 1:] * x).sum(1) - y) ** 2).sum())

        b, kept = niche.forward(w, maps, counts, activation, training=True)
        miss = b[:, 0] + (b[:, 1:] * x).sum(1) - y
        g = niche.backward(w, kept, 2 * miss[:, None] * np.column_stack([np.ones(6), x]), activation)
        assert set(g) == {k for k in w if "running" not in k and k != "anchors"}
        for k in g:
            at = tuple(rng.integers(0, s) for s in w[k].shape)
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            want = (loss(up) - loss(down)) / 2e-6
            assert abs(g[k][at] - want) < 1e-4 * max(1, abs(want)), (activation, k)


def test_training_lowers_the_error_and_models_round_trip():
    x, y, maps, counts = data()
    w, errors = niche.train(x, y, maps, counts, np.array([0.1, 1.0, 1.0, 1.0]), 30, 1e-2, "tanh")
    assert errors[-1] < errors[0]
    content = niche.packed_models({3: w, 4: w}, 8, "tanh", {4})
    models, side, activation = niche.unpacked_models(content)
    assert list(models) == [3] and side == 8 and activation == "tanh"
    a, b = (niche.forward(v, maps, counts, "tanh")[0] for v in (w, models[3]))
    assert a.shape == (12, 4) and np.allclose(a, b, atol=1e-4)
    assert niche.packed_models({4: w}, 8, skip={4}) is None


def test_groups(spark):
    x, _, maps, counts = data(20)
    y = 1.0 + 2.0 * x[:, 0]
    rows = [("G", int(i >= 10), i, float(y[i]) if i < 10 else 1.0, x[i].tolist(), [0, 1, 2], maps[i].ravel().tolist(), counts[i].tolist()) for i in range(20)]
    design = spark.createDataFrame(rows, "target string, cluster int, cell_idx long, y double, x array<double>, groups array<long>, map array<double>, counts array<double>")
    fits = niche.fit_groups(design, 3).persist()
    got = {r["cluster"]: r for r in fits.collect()}
    assert got[0]["model"] is not None and len(got[0]["epoch_mse"]) == 3 and got[1]["model"] is None  # no variance: R2 is 0
    beta = {r["cell_idx"]: r["beta"] for r in niche.predicted_betas(design, fits, 4).collect()}
    assert len(beta) == 20 and all(b == [0.0] * 4 for i, b in beta.items() if i >= 10)
    w = niche.unpacked_models(got[0]["model"])[0][0]
    want = niche.forward(w, maps[:10], counts[:10])[0]
    assert np.allclose([beta[i] for i in range(10)], want)
