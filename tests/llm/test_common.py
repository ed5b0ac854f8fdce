import random

import numpy as np

from timberline.llm.common import Rolling, components, words


def test_components_by_brute_force(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(999 - i, 998 - i) for i in range(60)] + [(5000, i) for i in range(4000, 4040)] + [(7, 7)]
    group = {x: x for e in edges for x in e}
    for _ in range(len(group)):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    lone = {x for x in group if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: g for x, g in group.items() if x not in lone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes_and_words():
    data = np.frombuffer(b"abcabc xyz  abc", np.uint8)
    r = Rolling(3)
    p = r.prefix(data)
    h = r.of(p, np.array([0, 3, 12, 0]), np.array([3, 6, 15, 6]))
    assert h[0] == h[1] == h[2] != h[3]
    start, end, row = words(data, np.array([0, 4, 4, 15]))
    assert [(int(a), int(b), int(k)) for a, b, k in zip(start, end, row)] == [(0, 4, 0), (4, 6, 2), (7, 10, 2), (12, 15, 2)]


def test_operators_bound_their_batches(spark):
    """A stage that gets its documents from elsewhere than `read` bounds Arrow batches too."""
    import corpus_pipeline
    from timberline.llm.common import BATCH_BYTES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(1, "the text of one row", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    old = spark.conf.get(name)
    try:
        for stage in ("language", "lines", "near_duplicates", "bpe"):
            spark.conf.set(name, str(64 << 20))
            dict(corpus_pipeline.STAGES)[stage](spark, df, "")
            assert int(spark.conf.get(name)) == BATCH_BYTES
    finally:
        spark.conf.set(name, old)


def test_scratch_deletes_what_is_not_kept(spark):
    from pathlib import Path

    from timberline.llm.common import scratch, stored

    there = lambda t: Path(t.stored_at).exists()
    with scratch(spark) as outer:
        with scratch(spark) as inner:
            a, b = stored(spark.range(3)), inner(stored(spark.range(4)))
        assert not there(a) and there(b) and b.count() == 4
        c = outer(stored(b.toDF("x")))
    assert not there(b) and there(c) and c.count() == 4
