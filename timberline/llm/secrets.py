"""Secret scanning: fixed patterns, and a character convolutional network in numpy over every candidate with its surrounding context.

Three base kinds are found by patterns and always stay. Any other run of at least 12 characters of a token's alphabet that holds a digit, or a capital behind a small letter, is a candidate too: keys and passwords,
but also numbers, addresses, paths, identifiers. The network sees all of a candidate, however long, with 32 characters before and 16 after it: a convolution slides over the whole and its
maximum over all places counts, so a key in the middle of a long run is seen. It is trained on labelled findings made from a fixed seed, its score is calibrated on others, and the threshold
is the highest that keeps the wanted recall on these. Candidates over it, or what base findings leave of them where that is a candidate too, become findings of kind `model`.

Rows: a null text counts as empty; very long texts are searched whole; repeated rows give repeated findings; an empty table gives no rows.
A column named findings is replaced."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import bounded_batches, read, steps

KINDS = ("assign", "access", "hex", "model")

# The base patterns, with the number of characters that a match (for assign: its second group) needs.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.@-]{12,}")
TELLING = re.compile(r"[0-9]|[a-z][A-Z]")
#: Texts without a match of these have no finding; they run in linear time over the column's own buffer.
SIEVES = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "model": r"[A-Za-z0-9+/_=.@-]([0-9]|[a-z][A-Z])|([0-9]|[a-z][A-Z])[A-Za-z0-9+/_=.@-]",
}
#: Characters of context, of a piece that is convolved at once, and of a filter.
BEFORE, AFTER, PIECE, SPAN = 32, 16, 96, 5
FINDINGS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("stop", "long").add("score", "double"))
LETTERS = 98


def base_findings(text: str, kinds: tuple[str, ...] = KINDS[:3]) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) in code points, leftmost and not overlapping within a kind."""
    out = []
    for kind in kinds:
        pattern, group, least = BASE[kind]
        # a run of fewer than 32 characters is dropped in any case, so the search may go for longer ones only
        search = re.compile(r"[0-9a-f]{32,}") if kind == "hex" else pattern
        out += [(m.start(), KINDS.index(kind), m.end()) for m in search.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in CANDIDATE.finditer(text) if TELLING.search(m[0])]


#: A character's place in the network's alphabet: printable ASCII, white space, other; the last one pads.
PLACES = np.full(129, 96, np.int64)
PLACES[33:127] = np.arange(94)
PLACES[[9, 10, 11, 12, 13, 32]] = 95
PAD = LETTERS - 1


def letters(text: str, start: int, end: int) -> np.ndarray:
    """The network's input: pieces x PIECE places in its alphabet, those of the candidate's characters apart from the context's. Pieces overlap by a filter's width less one, so
    that the maximum over all of them is that of one convolution over the whole."""
    low, high = max(0, start - BEFORE), min(len(text), end + AFTER)
    own = PLACES[np.minimum(np.frombuffer(text[low:high].encode("utf-32-le", "surrogatepass"), np.uint32), 128)].copy()
    own[start - low : end - low] += LETTERS
    own = np.concatenate([np.full(BEFORE - (start - low), PAD), own, np.full(AFTER - (high - end) + SPAN, PAD)])
    step = PIECE - SPAN + 1
    n = max(1, -(-(len(own) - SPAN + 1) // step))
    padded = np.full(n * step + SPAN - 1, PAD)
    padded[: len(own)] = own
    return np.lib.stride_tricks.sliding_window_view(padded, PIECE)[::step].copy()


def outside(text: str, start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base findings leave of a candidate, as far as it is a candidate itself."""
    out, at = [], start
    for low, _, high in [b for b in base if b[0] < end and start < b[2]] + [(end, 0, end)]:
        out += [(at + s, at + e) for s, e in candidates(text[at : max(at, low)])]
        at = max(at, high)
    return out


@dataclass
class Network:
    """One convolution over letters (a table for each offset), the maximum over places, and a linear layer; score = logistic(slope * z + shift)."""

    tables: np.ndarray  # SPAN, 2 * LETTERS, filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _convolved(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest response of each filter in each piece, and its place."""
        places = x.shape[1] - SPAN + 1
        h = sum(self.tables[k][x[:, k : k + places]] for k in range(SPAN))
        best = h.argmax(axis=1)
        return np.take_along_axis(h, best[:, None, :], axis=1)[:, 0] + self.bias, best

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._convolved(x[i : i + 128])[0] for i in range(0, len(x), 128)] or [np.zeros((0, len(self.out)), np.float32)])

    def margin(self, inputs: list[np.ndarray]) -> np.ndarray:
        """One number per candidate, from the pieces of each."""
        if not inputs:
            return np.zeros(0)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in inputs])[:-1]))
        return self.judged(np.maximum.reduceat(self.pooled(np.concatenate(inputs)), starts))

    def judged(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))

    def score(self, inputs: list[np.ndarray]) -> np.ndarray:
        return self.calibrated(self.margin(inputs))

    @staticmethod
    def fit(inputs: list[np.ndarray], y: np.ndarray, filters: int = 32, passes: int = 12, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        net = Network(r.normal(0, 0.1, (SPAN, 2 * LETTERS, filters)).astype(np.float32), np.zeros(filters, np.float32), r.normal(0, 0.3, filters).astype(np.float32), 0.0)
        moments: dict[str, list[np.ndarray]] = {}
        t, column = 0, np.arange(filters)[None, :]
        for _ in range(passes):
            for part in np.array_split(r.permutation(len(inputs)), max(1, len(inputs) // 64)):
                t += 1
                x = np.concatenate([inputs[i] for i in part])
                starts = np.concatenate(([0], np.cumsum([len(inputs[i]) for i in part])[:-1]))
                by_piece, best = net._convolved(x)
                h = np.maximum.reduceat(by_piece, starts)
                owner = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(x))))
                piece = np.minimum.reduceat(np.where(by_piece == h[owner], np.arange(len(x))[:, None], len(x)), starts)  # the piece that holds each maximum
                at = best[piece, column]
                a = np.maximum(h, 0)
                slip = (1 / (1 + np.exp(-(a @ net.out + net.out_bias))) - y[part]) / len(part)
                back = (slip[:, None] * net.out) * (h > 0)
                table = np.zeros_like(net.tables)
                for k in range(SPAN):
                    np.add.at(table[k], (x[piece, at + k], np.broadcast_to(column, at.shape)), back)
                for name, g in (("tables", table), ("bias", back.sum(0)), ("out", slip @ a), ("out_bias", slip.sum())):
                    m = moments.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
                    m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                    setattr(net, name, getattr(net, name) - 0.01 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8))
        return net

    def calibrate(self, inputs: list[np.ndarray], y: np.ndarray, recall: float) -> None:
        """Fits slope and shift by logistic regression on other findings, then takes the highest threshold that keeps `recall` of the true ones."""
        z, self.slope, self.shift = self.margin(inputs), 1.0, 0.0
        for _ in range(200):
            slip = self.calibrated(z) - y
            self.slope -= 0.1 * float((slip * z).mean())
            self.shift -= 0.1 * float(slip.mean())
        true = np.sort(self.calibrated(z[y == 1]))
        self.threshold = float(min(0.9, true[int((1 - recall) * len(true))]))


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is a secret) of made findings: random keys, passwords and access tokens, alone or inside longer runs; against them numbers, addresses, file names, checksummed
    identifiers, paths, versions, dates and long words."""
    r = random.Random(seed)
    pick = lambda letters, low, high: "".join(r.choice(letters) for _ in range(r.randint(low, high)))
    digits = string.digits
    word = lambda: pick("etaoinshrdlucmfw", 2, 9)
    words = lambda k: " ".join(word() for _ in range(k))
    joined = lambda mark, low, high: mark.join(word() for _ in range(r.randint(low, high)))
    mixed, base64, hexes = string.ascii_letters + digits, string.ascii_letters + digits + "+/", "0123456789abcdef"
    path = lambda: "/".join(r.choice([word(), word(), pick(digits, 2, 4), word().title()]) for _ in range(r.randint(2, 7)))
    key = lambda: r.choice([lambda: pick(mixed, 20, 44), lambda: pick(base64, 28, 88) + r.choice(["", "=", "=="]), lambda: pick(mixed, 14, 24)])()
    secrets = [
        key,
        lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "key-", "pk_test_", "AIza", "npm_"]) + pick(mixed, 20, 40),
        lambda: pick(hexes, 24, 64),
        lambda: "eyJ" + pick(mixed + "_-", 20, 60) + "." + pick(mixed + "_-", 30, 90) + "." + pick(mixed + "_-", 20, 44),
        lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16, 16),
        lambda: pick(string.ascii_uppercase + "234567", 20, 40),
        lambda: path() + "/" + key() + r.choice(["", "/" + path()]),
    ]
    others = [
        lambda: joined("-", 3, 8) + pick(digits, 1, 4),
        path,
        lambda: f"{r.choice(['19', '20'])}{pick(digits, 2, 2)}-{pick('01', 1, 1)}{pick(digits, 1, 1)}-{pick('012', 1, 1)}{pick(digits, 1, 1)}" + r.choice(["T", ".", "_"]) + pick(digits, 4, 8) + r.choice(["", "Z"]),
        lambda: joined("_", 2, 6) + r.choice(["_v", ".v", "_"]) + pick(digits, 1, 3),
        lambda: "".join(word().title() for _ in range(r.randint(2, 6))) + pick(digits, 0, 3),
        lambda: word() + "".join(word().title() for _ in range(r.randint(1, 5))),
        lambda: "-".join(pick(hexes, k, k) for k in (8, 4, 4, 4, 12)),
        lambda: r.choice("=-_.") * r.randint(10, 30) + word() + pick(digits, 1, 3),
        lambda: pick("etaoinshrdlu", 10, 30) + pick(digits, 1, 3),
        lambda: pick(digits, 12, 20),
        lambda: "-".join(pick(digits, 2, 5) for _ in range(r.randint(3, 5))),
        lambda: ".".join(pick(digits, 2, 3) for _ in range(4)),
        lambda: word() + r.choice([".", "_", "", "-"]) + pick(digits, 1, 4) + "@" + word() + pick(digits, 0, 1) + "." + word() + "." + r.choice(["com", "org", "de"]),
        lambda: joined(".", 2, 4) + r.choice(["@", "/"]) + joined(".", 2, 3) + pick(digits, 1, 2),
        lambda: "www." + joined(".", 1, 3) + ".org/" + path(),
        lambda: joined(".", 1, 3) + "." + pick(digits, 1, 2) + "." + pick(digits, 1, 2) + "." + pick(digits, 1, 3) + r.choice([".tar.gz", ".zip", "-beta2", ""]),
    ]
    out = []
    while len(out) < n:
        secret = r.random() < 0.5
        own = r.choice(secrets if secret else others)()
        lead = r.choice(["key = ", "auth: ", "Bearer ", "credential=", '"', "api ", "use ", "token ", "secret is ", "login ", "pw ", "see ", "file ", "http://", "uuid ", "page ", "ref=", "id ", "at ", "", ""])
        left = words(r.randint(0, 6)) + r.choice([" ", " ", "\n", "("]) + lead
        text = left + own + r.choice(["", " ", '"', ", ", ")", "\n"]) + words(r.randint(0, 4))
        if found := [c for c in candidates(text) if c[0] <= len(left) + 4 < c[1]]:
            out.append((text, *found[0], int(secret)))
    return out


@lru_cache(maxsize=4)
def trained(recall: float = 0.98, findings: int = 4000) -> Network:
    """The network, its size and training set the same whatever the input."""
    rows = labelled_findings(findings, 11)
    x, y = [letters(*r[:3]) for r in rows], np.array([r[3] for r in rows], np.float32)
    cut = findings * 3 // 4
    net = Network.fit(x[:cut], y[:cut])
    net.calibrate(x[cut:], y[cut:], recall)
    return net


def find_secrets(df: DataFrame, text: str = "text", recall: float = 0.98) -> DataFrame:
    """Replaces `text` by findings: array of (kind, start, stop, score), by start and then kind; start and stop in code points, stop exclusive. A narrow map over the scan."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(trained(recall))
    rest = [c for c in df.columns if c not in (text, "findings")]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def search(column: pa.Array, net: Network) -> list[list[dict]]:
        hit = {k: pc.fill_null(pc.match_substring_regex(column, s), False).to_numpy(zero_copy_only=False) for k, s in SIEVES.items()}
        out: list[list[dict]] = [[] for _ in range(len(column))]
        owners, spans, inputs, seen, pooled, held = [], [], [], [], [], 0

        def flush() -> None:
            """Convolves what has gathered, and keeps the maxima of each finding alone."""
            nonlocal held
            if inputs:
                which = np.array(seen)
                new = np.concatenate(([True], which[1:] != which[:-1]))
                pooled.append((which[new], np.maximum.reduceat(net.pooled(np.concatenate(inputs)), np.flatnonzero(new))))
            inputs.clear()
            seen.clear()
            held = 0

        for i in np.flatnonzero(np.any(list(hit.values()), axis=0)):
            t = column[int(i)].as_py()
            base = base_findings(t, tuple(k for k in KINDS[:3] if hit[k][i]))
            more = [(s, 3, e) for c in candidates(t) for s, e in outside(t, *c, base)] if hit["model"][i] else []
            for f in (*base, *more):
                pieces = letters(t, f[0], f[2])
                for k in range(0, len(pieces), 1024):
                    inputs.append(pieces[k : k + 1024])
                    seen += [len(owners)] * len(inputs[-1])
                    held += len(inputs[-1])
                    if held >= 1024:
                        flush()
                owners.append(int(i))
                spans.append(f)
        flush()
        if not owners:
            return out
        best = np.full((len(owners), len(net.out)), -np.inf)
        for which, h in pooled:
            best[which] = np.maximum(best[which], h)
        for i, (start, k, end), score in zip(owners, spans, net.calibrated(net.judged(best))):
            if k < 3 or score >= net.threshold:
                out[i].append({"kind": KINDS[k], "start": start, "stop": end, "score": float(score)})
        for found in out:
            found.sort(key=lambda f: (f["start"], KINDS.index(f["kind"])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(search(part.column(text), shared.value), kind)], names=[*rest, "findings"])

    schema = df.select(*rest).schema.add("findings", FINDINGS)
    return df.select(*rest, text).mapInArrow(run, schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")

    base = joined(F.filter("findings", lambda f: f["kind"] != "model"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
