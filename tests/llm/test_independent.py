"""Operators against versions that share no code with them: a PNG reader and a cosine transform by double sums, the recurrent
network by plain loops, and the pipeline's stages on tables that are empty, repeat rows or have names of their own."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline
from bizframe.llm import langid, queries
from pyspark.sql import functions as F


def read_png(data):
    """Width, height and rows of a grey 8-bit PNG, byte by byte."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, packed, width = 8, b"", 0
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            assert (depth, colour) == (8, 0)
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    raw, rows, up = zlib.decompress(packed), [], [0] * width
    for r in range(height):
        kind, line, row = raw[r * (width + 1)], raw[r * (width + 1) + 1 : (r + 1) * (width + 1)], []
        for x, v in enumerate(line):
            a, b, c = row[x - 1] if x else 0, up[x], up[x - 1] if x else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row.append((v + [0, a, b, (a + b) // 2, near][kind]) % 256)
        rows.append(row)
        up = row
    return rows


def transform_bits(rows, grid=32, low=8):
    """Block means, cosine transform by double sums, bits above the median without the mean level."""
    def blocks(n):
        return [[k] for k in [g * n // grid for g in range(grid)]] if n < grid else [list(range(g * n // grid, (g + 1) * n // grid)) for g in range(grid)]

    ys, xs = blocks(len(rows)), blocks(len(rows[0]))
    sums = np.array(rows, float)
    cells = [[sums[np.ix_(y, x)].mean() for x in xs] for y in ys]
    cos = [[math.cos(math.pi * (2 * n + 1) * k / (2 * grid)) * math.sqrt((1 if k == 0 else 2) / grid) for n in range(grid)] for k in range(low)]
    freq = [round(sum(cells[y][x] * cos[u][y] * cos[v][x] for y in range(grid) for x in range(grid)), 6) for u in range(low) for v in range(low)]
    rest = sorted(freq[1:])
    median = rest[len(rest) // 2]
    return "".join("1" if f > median else "0" for f in freq)


def test_media_is_a_png_and_its_transform(spark, sf):
    from bizframe.llm import media

    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text")).limit(12).select("doc_id", "text", media.pad_bytes(F.col("text")).alias("p"))
    rows = media.from_media(media.to_media(docs, "p"), keep=["doc_id", "text"]).collect()
    own = {r["doc_id"]: r for r in queries.op1_media(spark, sf).join(docs.select("doc_id"), "doc_id").collect()}
    assert len(rows) == len(own) == 12
    for r in rows:
        got = own[r["doc_id"]]
        image = read_png(bytes(r["media"]))
        data = r["text"].encode()
        assert b"".join(bytes(x) for x in image) == data + b"\xff" * (-len(data) % 576)
        assert (got["media_bytes"], got["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())
        assert bin(int(got["feature"], 16))[2:].zfill(64) == transform_bits(image)


def test_network_by_plain_loops():
    net = langid.train(["the cat sat on the mat " * 4, "der hund lief in das haus " * 4, "ñandú"], ["en", "de", "es"], steps=20)
    w = {k: v.astype(float) for k, v in net.weights.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def one(text):
        data, total = text.encode(), np.zeros(len(net.labels))
        for first in range(0, len(data), langid.SPAN):
            # a span is filled up with zero bytes, which the backward layer reads before the text's own
            span = list(data[first : first + langid.SPAN].ljust(langid.SPAN, b"\0"))
            hidden = {}
            for d, order in (("f", range(len(span))), ("b", range(len(span) - 1, -1, -1))):
                h = np.zeros(langid.HIDDEN)
                for t in order:
                    b = span[t]
                    z, r = sig(w[f"xz{d}"][b] + h @ w[f"uz{d}"]), sig(w[f"xr{d}"][b] + h @ w[f"ur{d}"])
                    n = np.tanh(w[f"xn{d}"][b] + r * (h @ w[f"un{d}"]))
                    h = (1 - z) * n + z * h
                    hidden[d, t] = h
            for t in range(min(langid.SPAN, len(data) - first)):
                e = hidden["f", t] @ w["vf"] + hidden["b", t] @ w["vb"] + w["c"][0]
                p = np.exp(e - e.max())
                total += p / p.sum()
        return total / len(data)

    texts = ["the dog", "das ist ein langer Text, " * 9, "ñ", "x" * 65]
    lang, score = langid.predict_batch(net, texts)
    for t, name, s in zip(texts, lang, score):
        p = one(t)
        assert name == net.labels[int(p.argmax())] and s == pytest.approx(p.max(), abs=1e-4)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stages(spark, df, folder):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        assert df.columns[:5] == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    return corpus_pipeline.STAGES[-1][1](spark, df, folder)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_repeated_rows_and_other_names(spark, tmp_path):
    rng = random.Random(3)
    text = lambda words, n: " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(k, text(["the", "cat", "house", "and"], 50), "en", "s", 1) for k in range(20)] + [(50 + k, text(["der", "haus", "katze", "und"], 50), "de", None, 1) for k in range(20)]
    rows += [rows[3]] * 4 + [(90, rows[5][1], None, None, None)] * 2 + [(91, None, "en", "s", 0)] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("size", F.lit("x")).withColumn("ids", F.lit(None).cast("int")).withColumn("class_id", F.col("doc_id"))
    out = [r["doc_id"] for r in stages(spark, df, str(tmp_path)).collect()]
    assert set(out) <= {r[0] for r in rows} - {91, 5} and len(set(out)) >= 20
    assert max(out.count(i) for i in set(out)) <= 2
