"""The SimHash step of the pipeline's near copies: what fingerprints and covering tables find by themselves."""

import random

from conftest import SF
from test_near_copies import brute_pairs

from tallywright.llm import near_copies, simhash


def test_fingerprints_find_most_near_copies(spark):
    """Pairs within the tables' three bits in any part are tied; most texts of similarity 0.8 are such pairs."""
    r = random.Random(3)
    rows = [[f"w{r.randrange(3000)}" for _ in range(200)] for _ in range(30)]
    rows += [[f"x{r.randrange(3000)}" if k in at else w for k, w in enumerate(row)] for row in rows[:] for at in [set(r.sample(range(200), 2))]]
    made = [" ".join(row) for row in rows]
    texts = sorted(set(made) | {t.text for t in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").limit(300).collect()})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marked = {r.digest: r.text for r in docs.select(near_copies.identity("text").alias("digest"), "text").collect()}
    met = near_copies.by_fingerprints(near_copies.sketches(docs)).collect()
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for p in met:
        root[find(marked[p.a])] = find(marked[p.b])
    fps = {t: [simhash.fingerprint(t.encode(), 1, simhash.HASH_SEED + i) for i in range(near_copies.PARTS)] for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            if any((x ^ y).bit_count() <= simhash.RADIUS for x, y in zip(fps[a], fps[b], strict=True)):
                assert find(a) == find(b)
    pairs = [(texts[i], texts[j]) for i, j in brute_pairs(texts)]
    assert len(pairs) >= 30 and sum(find(a) == find(b) for a, b in pairs) >= 0.8 * len(pairs)
