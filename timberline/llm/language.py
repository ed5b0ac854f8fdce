"""Language identification by hierarchical discrimination.

One-versus-one linear support vector machines first choose the language family, then, within it, the language. All machines work on
hashed counts of byte n-grams (1 to 3) of the lower-cased letters of the whole text.

The sample is bounded by parameters of fit_language_model; pairs are trained in parallel tasks, and the driver holds the sample and the machines, neither of which grows with the rows.

Rows: a null text, or one without any letter, is `und` with score 0. Very long texts count whole. Repeated rows give repeated
results; an empty table or one without labels trains nothing and predicts `und`. Columns named lang_pred or score are replaced."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import beside, bounded_batches, read, steps, text_buffer

#: Hashed feature buckets.
WIDTH = 2048

# Language families of ISO 639-1 codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa ur",
}


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes.split()), f"only {lang}")


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: square roots of n-gram counts by hashed bucket, to unit length."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    data, at = text_buffer(lower)
    n = len(at) - 1
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    b = np.where(letter, data, 32).astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    out = np.zeros(n * WIDTH, np.float64)
    gram = np.zeros(len(b), np.uint32)
    for size in (1, 2, 3):
        held = len(b) - size + 1
        if held <= 0:
            break
        gram = (gram[:held] << np.uint32(8)) | b[size - 1 :]
        keep = (row[:held] == row[size - 1 :]) & (letter[:held] | letter[size - 1 :])
        bucket = ((gram + np.uint32(size << 25)) * np.uint32(2654435761)) >> np.uint32(32 - WIDTH.bit_length() + 1)
        out += np.bincount((row[:held] * WIDTH + bucket)[keep], minlength=n * WIDTH)
    out = np.sqrt(out).reshape(n, WIDTH)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 8.0, passes: int = 30, seed: int = 0) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    square, alpha, w = np.einsum("ij,ij->i", x, x) + 0.5 / c, np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / c
            step = max(alpha[i] - slope / square[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w.astype(np.float32)


@dataclass
class Choice:
    """One-versus-one machines among `names`; the one with most pairwise wins is chosen, ties by margins then by order."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @staticmethod
    def of(names: list[str], machines: dict[tuple[str, str], np.ndarray]) -> Choice:
        pairs = list(combinations(range(len(names)), 2))
        return Choice(names, pairs, np.array([machines[names[a], names[b]] for a, b in pairs], np.float32).reshape(len(pairs), WIDTH + 1))

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the chosen name and a score from 0 to 1: the mean logistic of its pairwise margins."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        wins, sure = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-4 * np.clip(margins[:, k], -20, 20)))
            wins[:, a] += p > 0.5
            wins[:, b] += p <= 0.5
            sure[:, a] += p
            sure[:, b] += 1 - p
        sure /= n - 1
        best = np.argmax(wins + 0.5 * sure, axis=1)
        return best, sure[np.arange(len(x)), best]


@dataclass
class LanguageModel:
    families: Choice | None
    within: dict[str, Choice]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        if self.families is None or not lettered.any():
            return list(names), scores
        x = features(texts)
        group, sure = self.families.choose(x)
        for k, f in enumerate(self.families.names):
            if (own := np.flatnonzero(lettered & (group == k))).size:
                best, inner = self.within[f].choose(x[own])
                names[own] = np.array(self.within[f].names, object)[best]
                scores[own] = np.clip(sure[own] * inner, 0, 1)
        return list(names), scores


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit_language_model(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 300, most_rows: int = 4000, most_languages: int = 64) -> LanguageModel:
    """Learns from a bounded sample: of the `most_languages` most frequent labels, `per_language` rows each (fewer if that would be over `most_rows` in all), those with the
    least hash of their id. Counts by language first give the share to draw, so nothing is sorted or gathered beyond the sample. Each pair's machine is trained in a task of its own."""
    bounded_batches(df.sparkSession)
    learn = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(3), F.col(doc_id)).alias("draw"))
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return LanguageModel(None, {})
    each = max(1, min(per_language, most_rows // len(counts)))
    shares = df.sparkSession.createDataFrame([(k, min(1.0, 1.3 * each / n)) for k, n in counts.items()], "known string, share double")
    drawn = learn.join(F.broadcast(shares), F.col("lang") == F.col("known")).where((F.col("draw") / F.lit(2.0**64) + F.lit(0.5)) < F.col("share")).select("lang", "text", "draw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps([batch], "text"):
                rows = features(part.column("text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("draw"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "draw", "x"])

    rows = sorted(((r["lang"], r["draw"], bytes(r["x"])) for r in drawn.mapInArrow(run, "lang string, draw long, x binary").toLocalIterator()))
    taken: dict[str, int] = {}
    kept = [r for r in rows if taken.setdefault(r[0], 0) < each and not taken.update({r[0]: taken[r[0]] + 1})]
    if not kept:
        return LanguageModel(None, {})
    return _trained(df.sparkSession, np.array([np.frombuffer(r[2], np.float16) for r in kept]), np.array([r[0] for r in kept], object))


def _trained(spark: SparkSession, x: np.ndarray, y: np.ndarray) -> LanguageModel:
    """All pairs' machines from the sample (half floats), between families and within each."""
    group = np.array([family(v) for v in y], object)
    names = {"": sorted(set(group))} | {f: sorted(set(y[group == f])) for f in set(group)}
    pairs = [(k, a, b) for k, own in sorted(names.items()) for a, b in combinations(own, 2)]
    machines: dict[str, dict[tuple[str, str], np.ndarray]] = {k: {} for k in names}
    if pairs:
        shared = spark.sparkContext.broadcast((x, y, group))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y, group = shared.value
            for batch in batches:
                for r in batch.to_pylist():
                    label = group if r["within"] == "" else y
                    own = (label == r["a"]) | (label == r["b"])
                    w = train_svm(x[own].astype(np.float32), np.where(label[own] == r["a"], 1.0, -1.0))
                    yield pa.RecordBatch.from_pylist([r | {"w": w.tobytes()}], schema=pa.schema([("within", pa.string()), ("a", pa.string()), ("b", pa.string()), ("w", pa.binary())]))

        todo = spark.createDataFrame(pairs, "within string, a string, b string").repartition(len(pairs))
        for r in todo.mapInArrow(run, "within string, a string, b string, w binary").collect():
            machines[r["within"]][r["a"], r["b"]] = np.frombuffer(r["w"], np.float32)
    choices = {k: Choice.of(own, machines[k]) for k, own in names.items()}
    return LanguageModel(choices.pop(""), choices)


def predict_language(df: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred and score: a narrow map over the scan."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in df.columns if c not in ("lang_pred", "score") and (keep_text or c != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            names, scores = shared.value.predict(part.column(text))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    schema = df.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    return df.select(*dict.fromkeys([*rest, text])).mapInArrow(run, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs)
    return predict_language(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep_text=False)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; all columns stay as they are. Where nothing could be learned, all with a letter stay."""
    model = fit_language_model(docs)
    if model.families is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return beside(docs, ("doc_id", "text", "lang"), lambda d: predict_language(d, model).where("lang_pred <> 'und'"))
