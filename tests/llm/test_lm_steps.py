import numpy as np

from tallyglass.llm import lm


def tokens(n=3000, size=400):
    p = lm.Parameters(np.sort(np.random.default_rng(0).zipf(1.3, size).clip(1, 5000))[::-1].astype(np.int64))
    rng = np.random.default_rng(1)
    u, v, w = (np.minimum(rng.zipf(1.4, n) - 1, size - 1) for _ in range(3))
    return p, u, v, w


def test_log_p_in_any_order_and_size():
    """Blocks of tokens in the order of their words give what each token gives by the definition, also where scores are large."""
    p, u, v, w = tokens()
    for factor in (1, 40):
        big = p.filled(p.flat() * np.float32(factor))
        a, b, r, bias, s, s_bias = (t.astype(np.float64) for t in big.tables)
        q, want = a[u] + b[v], np.empty(len(w))
        soft = lambda x, at: x[at] - x.max() - np.log(np.exp(x - x.max()).sum())
        for i in range(len(w)):
            k = p.of[w[i]]
            lo, hi = p.edges[k], p.edges[k + 1]
            want[i] = soft(s @ q[i] + s_bias, k) + soft(r[lo:hi] @ q[i] + bias[lo:hi], w[i] - lo)
        assert np.allclose(big.log_p(u, v, w), want, rtol=1e-4, atol=1e-3)


def test_a_batch_in_any_order_teaches_the_same():
    p, u, v, w = tokens()
    order = np.random.default_rng(2).permutation(len(w))
    one, two = lm.Trainer(p, 7), lm.Trainer(p, 7)
    one.learn(u, v, w)
    two.learn(u[order], v[order], w[order])
    assert np.allclose(one.p.flat(), two.p.flat(), atol=1e-4) and not np.allclose(one.p.flat(), p.flat(), atol=1e-3)
