import collections
import math
import zlib

import llm_paths  # noqa: F401
import numpy as np
import pytest
from texts import ODD, frame, odd, prose, rows

from broadsheet.llm import arrays, lm


def brute(docs, learns):
    """The model read plainly from its formulas."""
    tokens = {d: (t or "").encode().lower().split() + [None] for d, t in docs}
    count, pairs = collections.Counter(), collections.Counter()
    for d, _ in docs:
        if learns(d):
            before = "start"
            for w in tokens[d]:
                count[w] += 1
                pairs[before, w] += 1
                before = w
    total, kinds = sum(count.values()), len(count)
    contexts, fronts = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (a, b), n in pairs.items():
        contexts[a][0] += n
        contexts[a][min(n, 3)] += 1
        fronts[b] += 1
    often = lambda c: np.array([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])
    two, one = lm.discounts(often(pairs)), lm.discounts(often(fronts))
    left = sum(one[min(v, 3) - 1] for v in fronts.values()) / len(pairs)

    def single(w):
        n = fronts[w]
        return (n - (one[min(n, 3) - 1] if n else 0)) / len(pairs) + left / (kinds + 1)

    def double(a, w):
        if a not in contexts:
            return single(w)
        n, t = pairs[a, w], contexts[a]
        return (n - (two[min(n, 3) - 1] if n else 0)) / t[0] + sum(two[k - 1] * t[k] for k in (1, 2, 3)) / t[0] * single(w)

    out = {}
    for d, _ in docs:
        before, score, base, known = "start", 0.0, 0.0, 0
        for w in tokens[d]:
            score += math.log10(double(before, w))
            base += math.log10((count[w] + 1) / (total + kinds + 1))
            known += count[w] > 0
            before = w
        out[d] = (len(tokens[d]), known, total, base, score)
    chances = sum(double("start", w) for w in count) + sum(two[k - 1] * contexts["start"][k] for k in (1, 2, 3)) / contexts["start"][0] * left / (kinds + 1)
    assert abs(chances - 1) < 1e-9
    return out


@pytest.mark.parametrize("shard", [1 << 21, 64])
def test_equals_brute_force(spark, monkeypatch, shard):
    for name in ("SHARD", "RANGE", "BUFFER"):
        monkeypatch.setattr(lm, name, shard)
    docs = [(d, t) for d, t, *_ in rows(*ODD, *(prose(k, 80) for k in range(60)), prose(1, 80), prose(99, 4000))]
    want = brute(docs, lambda d: zlib.crc32(str(d).encode()) % 7 != 2)
    got = lm.digests(frame(spark, docs, "doc_id bigint, text string")).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_odd_rows_and_no_training(spark):
    docs = odd(spark)
    assert lm.digests(docs).count() == docs.count()
    assert lm.digests(docs.limit(0)).count() == 0
    from pyspark.sql import functions as F

    none = lm.scored(docs.select("doc_id", "text", F.lit(1).alias("score")), F.lit(False)).collect()
    assert len(none) == docs.count() and all(r.train_tokens == 0 and r.score == 0 for r in none)


def test_sorted_files(tmp_path):
    runs = []
    for lo in (50, -20):
        keys = np.arange(lo, lo + 20, 2)
        runs.append(arrays.Run(lo, len(keys), arrays.write(f"file://{tmp_path}/x", [keys, (keys * 3).astype(np.uint32)]), ("i8", "u4")))
    table = arrays.Sorted(f"file://{tmp_path}/x", runs)
    at = table.find(np.array([-30, -20, -19, -2, 50, 68, 70]))
    assert at.tolist() == [-1, 0, -1, 9, 10, 19, -1]
    assert table.take(np.array([-1, 10, 19]), 1).tolist() == [0, 150, 204]
