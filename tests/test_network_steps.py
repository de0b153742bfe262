"""A step of the network runs over packed rows in an RDD, without a plan of its own."""

import numpy as np

from vigilo.plans import network as N


def test_a_step_sums_the_drawn_batches_however_they_are_dealt(spark):
    rng = np.random.default_rng(5)
    layers = [3, 4, 1]
    flat = N.first_weights(layers, 1)
    rows, data = [], {}
    for shard in range(5):
        for batch in range(3):
            x, y = rng.normal(size=(6 + shard, 3)).astype(np.float32), rng.integers(0, 2, 6 + shard).astype(np.float32)
            data[shard, batch] = x, y
            rows.append((shard, batch, x.tobytes(), y.tobytes()))
    drawn = {0: 2, 1: 0, 3: 1}                        # shards 2 and 4 have no batch left
    own = [N.loss_and_gradient(flat, layers, *(c.astype(np.float64) for c in data[s, b]), 0.3, np.random.default_rng([1, 2, s]))
           for s, b in drawn.items()]
    for parts in (1, 2, 5):
        loss, n, gradient = N.step_gradient(spark.sparkContext.parallelize(rows, parts), flat, layers, drawn, 0.3, (1, 2))
        assert n == sum(6 + s for s in drawn)
        assert np.isclose(loss, sum(r[0] for r in own), rtol=1e-12)
        assert np.allclose(gradient, sum(r[1] for r in own), rtol=1e-12, atol=1e-14)
