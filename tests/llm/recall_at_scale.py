"""Recall of the neighbour index by size: run as a program, with numbers of rows; not a test.

Vectors are drawn with the label means and spreads of a given table. The
number of projections is fitted as the operator fits it, on other queries than
those that are then asked.
"""

import math
import sys

import numpy as np
import pyarrow.parquet as pq

from siltstone.llm import neighbours as K

TABLES, WIDTH, PROBES, RECALL, SAMPLE, TOP = 14, 2.6, 80, 0.95, 64, 5


def drawn(source: str, rows: int, rng: np.random.Generator) -> np.ndarray:
    t = pq.read_table(source)
    v, label = np.array(t["embedding"].to_pylist(), np.float32), np.array(t["label"].to_pylist())
    means, spreads = np.array([v[label == k].mean(0) for k in np.unique(label)]), np.array([v[label == k].std(0) for k in np.unique(label)])
    at = rng.integers(len(means), size=rows)
    out = rng.standard_normal((rows, v.shape[1]), dtype=np.float32) * spreads[at] + means[at]
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def exact(v: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    best = []
    for q in queries.tolist():
        s = v @ v[q]
        s[q] = -2
        best.append(np.argpartition(-s, TOP)[:TOP])
    return best


def main(source: str, sizes: list[int]) -> None:
    rng = np.random.default_rng(11)
    for rows in sizes:
        v = drawn(source, rows, rng)
        chosen = rng.choice(rows, SAMPLE + 60, replace=False)
        fit, ask = chosen[:SAMPLE], chosen[SAMPLE:]
        sample = [(v[q].astype(np.float64), v[near].astype(np.float64)) for q, near in zip(fit.tolist(), exact(v, fit), strict=True)]
        functions = K.fitted_functions(sample, max(1, int(math.log2(rows)) - 3), TABLES, WIDTH, PROBES, RECALL)
        h = K.Hashes(v.shape[1], TABLES if functions else 1, functions, WIDTH)
        names = np.concatenate([h.names(h.cells(v[k : k + 50_000].astype(np.float64))[0]) for k in range(0, rows, 50_000)])
        hits, candidates = [], []
        for q, near in zip(ask.tolist(), exact(v, ask), strict=True):
            found = np.zeros(rows, bool)
            for t, there in enumerate(K.visited(h, v[q].astype(np.float64), PROBES)):
                found |= np.isin(names[:, t], there)
            hits.append(found[near].mean())
            candidates.append(found.mean())
        print(f"{rows} rows: {functions} functions, recall {np.mean(hits):.3f}, candidates {np.mean(candidates):.1%}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], [int(x) for x in sys.argv[2:]])
