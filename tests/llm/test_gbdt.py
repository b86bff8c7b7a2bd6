import numpy as np

from spanforge.llm import gbdt


def test_learns_an_interaction_and_traverses_like_a_loop():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = gbdt.fit(x[:2000], y[:2000])
    p = model.probability(x[2000:])
    assert ((p >= 0.5) == y[2000:]).mean() > 0.97
    for row, value in zip(x[2000:2020], model.raw(x[2000:2020]), strict=True):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - (2**model.depth - 1)]
        assert abs(total - value) < 1e-9


def test_nothing_to_learn():
    assert gbdt.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert gbdt.fit(np.ones((4, 1)), np.ones(4)).probability(np.ones((1, 1)))[0] > 0.8
    assert gbdt.fit(np.ones((4, 1)), np.array([0, 1, 0, 1.0])).probability(np.ones((1, 1))).shape == (1,)


def test_isotonic_is_monotone_and_pools():
    f = gbdt.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0, 1, 0, 1, 1.0]))
    grid = f(np.linspace(0, 1, 50))
    assert (np.diff(grid) >= 0).all() and grid[0] == 0 and grid[-1] == 1 and abs(f(np.array([0.25]))[0] - 0.5) < 1e-9
    assert gbdt.isotonic(np.zeros(0), np.zeros(0))(np.array([0.3]))[0] == 0.3
