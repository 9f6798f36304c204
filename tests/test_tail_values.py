import time

import numpy as np

from helixframe.operators.count_models import beta_ratio, nb_tails, upper_gamma


def test_many_tails_stand_one_by_one():
    """Values of many rows are those of each row alone, and take no more steps for being many."""
    rng = np.random.default_rng(5)
    n = 10_000
    k, lam, phi = np.rint(rng.gamma(4, 400, n)), rng.gamma(4, 400, n), rng.choice([0.3, 0.02, 1e-6], n)
    start = time.time()
    low, high = nb_tails(k, lam, phi)
    gamma = upper_gamma(k + 1, lam)
    assert time.time() - start < 20
    for i in range(0, n, 500):
        one = nb_tails(k[i : i + 1], lam[i : i + 1], phi[i : i + 1])
        assert np.allclose([low[i], high[i]], np.ravel(one), rtol=1e-12, atol=1e-300)
        assert np.allclose(gamma[i], upper_gamma(k[i : i + 1] + 1, lam[i : i + 1])[0], rtol=1e-12, atol=1e-300)
    assert beta_ratio(np.array([[0.0, 0.5], [1.0, 0.5]]), 2.0, 2.0).tolist() == [[0.0, 0.5], [1.0, 0.5]]
