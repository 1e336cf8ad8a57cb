"""A group of the ranking is read batch by batch: what it needs beside its input does not grow with it."""

import tracemalloc

import numpy as np
import pyarrow as pa

from gleaner.operators.ranking import _products

SCHEMA = pa.schema([("user_id", pa.int64()), ("job_id", pa.int64()), ("dot", pa.float64()), ("square", pa.float64())])


def batch(at, n, k, ids):
    offsets = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(np.resize(ids, n * k)), pa.array(np.ones(n * k, np.int32)))]
    same = lambda v, t: pa.array(np.full(n, v, t))
    return pa.record_batch([same(0, np.int64), pa.array(np.arange(at, at + n)), *lists, same(1.0, float), same(1, np.int64), same(0, np.int64)], ["user_id", "job_id", "ids", "counts", "single", "shards", "shard"])


def test_memory_of_a_group():
    ids = np.arange(1000) * 7919
    weights = pa.table({"id": ids[:900], "idf": np.full(900, 2.0), "pw": np.full(900, 3.0)})
    postings = pa.Table.from_batches([batch(256 * i, 256, 200, ids) for i in range(16)])
    tracemalloc.start()
    got = _products("user_id", "job_id", SCHEMA)(postings, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["job_id"].to_pylist() == list(range(4096)) and peak < 8_000_000
    known = np.isin(np.resize(ids, 256 * 200), ids[:900]).reshape(256, 200).sum(1)
    assert np.allclose(got["dot"].to_numpy()[:256], known * 6.0) and np.allclose(got["square"].to_numpy()[:256], known * 4.0 + (200 - known))
