import base64
import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from timberline.llm.secrets import AFTER, BEFORE, LETTERS, PAD, SPAN, base_findings, candidates, find_secrets, letters, op8_secrets, trained

ORDER = ["assign", "access", "hex"]


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_by_brute_force(spark):
    r = random.Random(2)
    parts = ["password", "PassWd", "token", "toKen", "ſecret", "secret", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef" * 2, "abcdef", "xyz.12+/", "é", "\n", "Zz9_-"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(2000)]
    for t in texts:
        assert base_findings(t) == brute(t), t
    rows = [*enumerate(texts[:300]), (900, None), (901, ""), (902, "x " * 40000 + "token: abcdefgh9"), (902, "x " * 40000 + "token: abcdefgh9"), (None, "é token=12345678")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("findings", F.lit(1))
    got = find_secrets(df).collect()
    assert len(got) == len(rows)
    for x in got:
        text = dict(rows)[x.doc_id]
        assert [(f.start, ORDER.index(f.kind), f.stop) for f in x.findings if f.kind != "model"] == brute(text)
    assert find_secrets(df.limit(0)).count() == 0


def made(n, seed):
    """Secrets that the training generator does not make: digests in several notations, and passwords of syllables with marks."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        raw = hashlib.sha512(f"{seed} {i}".encode()).digest()
        short, alphabet = raw[: r.randint(15, 40)], "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
        out.append(
            [
                base64.b64encode(short).decode(),
                base64.urlsafe_b64encode(short).decode().rstrip("="),
                "".join(alphabet[b % 58] for b in short),
                f"SG.{base64.urlsafe_b64encode(raw[:16]).decode()[:22]}.{base64.urlsafe_b64encode(raw[16:48]).decode()[:43]}",
                raw[:14].hex(),
                base64.b32encode(raw[:20]).decode(),
            ][i % 6]
        )
    return out


def test_network_on_secrets_made_otherwise():
    r = random.Random(4)
    prose = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t and len(t) > 500]
    net, inputs = trained(), []
    for own in made(600, 5):
        t = r.choice(prose)
        at = r.randrange(len(t))
        text = t[:at] + r.choice([" ", "\n", ' "', " -u ", " dsn "]) + own + r.choice([" ", "\n", '"', ";"]) + t[at:]
        middle = text.index(own, at) + len(own) // 2
        (spot,) = [c for c in candidates(text) if c[0] <= middle < c[1]]
        inputs.append(letters(text, *spot))
    assert (net.score(inputs) >= net.threshold).mean() >= 0.95


def test_network_leaves_numbers_and_addresses_alone():
    net, inputs = trained(), []
    for t in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist():
        base = brute(t)
        inputs += [letters(t, s, e) for s, e in candidates(t or "") if not any(b[0] < e and s < b[2] for b in base)]
    assert len(inputs) > 500 and (net.score(inputs) >= net.threshold).mean() <= 0.01


def slow_score(net, text, start, end):
    """The network by its definition: every filter at every place of the whole."""

    def place(c):
        return ord(c) - 33 if "!" <= c <= "~" else 95 if c in " \t\n\v\f\r" else 96

    own = [place(text[i]) + LETTERS * (start <= i < end) if 0 <= i < len(text) else PAD for i in range(start - BEFORE, end + AFTER)] + [PAD] * SPAN
    best = np.max([sum(net.tables[k][own[i + k]] for k in range(SPAN)) for i in range(len(own) - SPAN + 1)], axis=0) + net.bias
    z = float(np.maximum(best, 0) @ net.out + net.out_bias)
    return 1 / (1 + np.exp(-(net.slope * z + net.shift)))


def test_spans_by_brute_force(spark):
    r = random.Random(9)
    net, keys = trained(), made(80, 3)
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(r.choice([r.choice(keys), "/".join(["some", "path"] * r.randint(1, 60)) + "/2019", "token=" + r.choice(keys), "wordwordword" * r.randint(1, 9) + "X7", "a.34@mail7.example.com", "é" * 5, "0123456789abcdef" * 3, "camelCaseNames" * 3, "9807915762804490"]))
        rows.append((i, r.choice([" ", "\n", " \U0001f600 "]).join(parts)))
    want = {}
    for i, t in rows:
        base, found = brute(t), []
        free = "".join("\0" if any(s <= k < e for s, _, e in base) else c for k, c in enumerate(t))
        for m in re.finditer(r"[A-Za-z0-9+/_=.@-]{12,}", free):
            if re.search(r"\d|[a-z][A-Z]", m[0]) and slow_score(net, t, m.start(), m.end()) >= net.threshold:
                found.append((m.start(), 3, m.end()))
        want[i] = sorted([*base, *found])
    got = {x.doc_id: [(f.start, [*ORDER, "model"].index(f.kind), f.stop) for f in x.findings] for x in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(k == 3 for v in want.values() for _, k, _ in v) > 30


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op8_secrets(spark, d).collect():
        want = brute(texts[r.doc_id])
        line = ",".join(f"{ORDER[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_key_inside_a_long_token(spark):
    path = "/".join(["stories", "letters", "notes", "reader", "winter", "summer", "collection", "2019", "chapter", "garden"])
    key = "q7Zr2KfW9xLb4VtN8mYs3HcD6pGj1TaE"
    texts = ["see " + path + "/option=" + key + "/" + path, "see " + path + "/option/" + path, "0123456789abcdef" * 2 + "/" + key, key, "see " + (path + "/") * 3000 + key + ("/" + path) * 3000]
    rows = find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    got = [[(f.kind, f.start, f.stop) for f in r.findings] for r in rows]
    assert got == [[("model", 4, len(texts[0]))], [], [("hex", 0, 32), ("model", 32, 65)], [("model", 0, 32)], [("model", 4, len(texts[4]))]]
