"""What MinHash signatures of whole items find, for the README: python tests/llm/measure_minhash.py SF_DIR.

Items fall into size classes of powers of two; documents are cut into windows of the class's size, half overlapping.
A pair is a candidate if the share of equal minima, turned into a containment by the two sizes, reaches a threshold.
"""

import sys
from pathlib import Path

import duckdb
import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from pathloom.llm.leakage import SHINGLE, _rolled, _B1, word_hashes  # noqa: E402

K, RUN = 128, 12
rng = np.random.default_rng(7)
A, B = rng.integers(1, 1 << 63, K, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, K, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.unique(shingles)[:, None] * A + B
        return (x ^ (x >> np.uint64(29))).min(axis=0)


def main(folder: str) -> None:
    read = lambda t, k, c: duckdb.sql(f"SELECT {k}, {c} FROM '{folder}/{t}.parquet' WHERE {c} IS NOT NULL").fetchall()
    items = {k: h for k, t in read("eval_items", "item_id", "passage") if len(h := word_hashes(t)) >= RUN}
    docs = {k: h for k, t in read("documents", "doc_id", "text") if len(h := word_hashes(t)) >= RUN}
    runs = {}
    for i, h in items.items():
        for x in _rolled(h, RUN, _B1).tolist():
            runs.setdefault(x, set()).add(i)
    true = {(d, i) for d, h in docs.items() for x in _rolled(h, RUN, _B1).tolist() for i in runs.get(x, ())}
    best, windows = {}, 0
    by_class = {}
    for i, h in items.items():
        by_class.setdefault(1 << (len(h) - 1).bit_length(), []).append(i)
    for size, ids in by_class.items():
        sig = np.array([signature(_rolled(items[i], SHINGLE, _B1)) for i in ids])
        n = np.array([len(np.unique(_rolled(items[i], SHINGLE, _B1))) for i in ids])
        for d, h in docs.items():
            for at in range(0, max(1, len(h) - size // 2), size // 2):
                w = _rolled(h[at : at + size], SHINGLE, _B1)
                if not len(w):
                    continue
                windows += 1
                j = (sig == signature(w)).mean(axis=1)
                share = j / (1 + j) * (n + len(w)) / n
                for k in np.flatnonzero(share > 0):
                    best[d, ids[k]] = max(best.get((d, ids[k]), 0), share[k])
    for t in (0.8, 0.5, 0.2, 0.05):
        got = {p for p, s in best.items() if s >= t}
        print(f"containment {t}: recall {len(got & true) / len(true):.3f}, candidates that leak {len(got & true) / max(1, len(got)):.3f}, {windows * K} minima of {sum(map(len, docs.values()))} words")
    print("window minima: recall 1.000,", sum(1 + np.count_nonzero(np.diff(sk)) for h in docs.values() for sk in [least(h)]), "minima")


def least(h: np.ndarray) -> np.ndarray:
    from pathloom.llm.leakage import sketch

    return sketch(h, RUN)[0]


if __name__ == "__main__":
    main(sys.argv[1])
