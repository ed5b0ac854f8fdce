import math
import zlib
from collections import Counter

from timberline.llm.language import WIDTH, family, fit_language_model, op2_language, predict_language, stage_language


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op2_language(spark, d).collect()
    assert len(rows) == len(lang)
    right = n = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out:
            n += 1
            right += r.lang_pred == lang[r.doc_id]
    assert right >= 0.97 * n


def test_odd_rows(spark):
    long = "the and of thing " * 20000
    rows = [(1, "der die und das nicht ist", "de", "a"), (3, "the and of with that", "en", "b"), (5, "el de la que los con", "es", "c"), (None, None, "fr", "d"), (7, "", "fr", "e"), (8, "123 ### !!", None, "f"), (9, long, None, "g"), (9, long, None, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = fit_language_model(df)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in predict_language(df, model).collect()}
    assert got[None, None] == got[7, ""] == got[8, "123 ### !!"] == ("und", 0.0)
    assert got[9, long][0] == "en"
    assert stage_language(spark, df, "").columns == df.columns and stage_language(spark, df, "").count() == 5
    empty = df.limit(0)
    assert predict_language(empty, fit_language_model(empty)).count() == 0
    assert predict_language(df, fit_language_model(empty)).where("lang_pred <> 'und'").count() == 0


def test_stage_without_labels(spark):
    rows = [(1, "the and of with that", None, "a"), (3, "ü", None, "b"), (5, None, None, "c"), (7, "123 ### !!", None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = stage_language(spark, df, "")
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def slow_features(text):
    """Bucket counts of byte n-grams by their definition."""
    data = [b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode()]
    out = Counter()
    for size in (1, 2, 3):
        for i in range(len(data) - size + 1):
            gram = data[i : i + size]
            if gram[0] != 32 or gram[-1] != 32:
                code = (sum(b << 8 * (size - 1 - k) for k, b in enumerate(gram)) + (size << 25)) & 0xFFFFFFFF
                out[(code * 2654435761 & 0xFFFFFFFF) >> (32 - WIDTH.bit_length() + 1)] += 1
    norm = math.sqrt(sum(out.values()))
    return {k: math.sqrt(v) / norm for k, v in out.items()}


def slow_choice(choice, x):
    """All pairs vote; most wins, then the larger mean of certainty."""
    wins, sure = Counter(), Counter()
    for k, (a, b) in enumerate(choice.pairs):
        w = choice.weights[k]
        p = 1 / (1 + math.exp(-4 * (sum(float(w[i]) * v for i, v in x.items()) + float(w[-1]))))
        wins[a if p > 0.5 else b] += 1
        sure[a] += p
        sure[b] += 1 - p
    return max(range(len(choice.names)), key=lambda i: wins[i] + 0.5 * sure[i] / max(1, len(choice.names) - 1))


def test_predictions_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language_model(docs)
    assert set(model.families.names) == {family(x) for c in model.within.values() for x in c.names}
    got = {r.doc_id: r.lang_pred for r in predict_language(docs, model).collect()}
    for r in docs.collect():
        want = "und"
        if r.text and any(c.isalpha() for c in r.text):
            x = slow_features(r.text)
            inner = model.within[model.families.names[slow_choice(model.families, x)]]
            want = inner.names[slow_choice(inner, x)]
        assert got[r.doc_id] == want


def test_learned_labels_are_bounded(spark):
    rows = [(4 * i, " ".join(chr(97 + k) * 3 + chr(98 + k) for _ in range(9)), f"l{k:02d}") for k in range(12) for i in range(200 * k, 200 * k + 40 + 14 * k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(df, per_language=8, most_rows=50, most_languages=5)
    assert sorted(x for c in model.within.values() for x in c.names) == [f"l{k:02d}" for k in range(7, 12)]
    got = [(r.lang, r.lang_pred) for r in predict_language(df, model).collect() if r.lang >= "l07"]
    assert sum(a == b for a, b in got) >= 0.95 * len(got)
