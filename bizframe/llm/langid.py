"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Texts are read as UTF-8 bytes, cut into spans of SPAN bytes that share no state. Two gated recurrent layers, one from
either end, label every byte of every span; a document's probabilities are the means over all its bytes. Training runs
backpropagation through time with Adam on a bounded, documented sample: for each label the `per_label` documents with
text that come first by a seeded hash of id and text (fewer where there are so many labels that they would be more than
`most` documents, one at least, whatever ids and texts repeat). Of a sampled document three pieces of `piece` characters are learned from, its start, middle
and end, since the sample is gathered on the driver and a text may have any length; training draws spans of SPAN bytes
from them. Every label is learned. Prediction reads whole texts, a batch at a time, and shuffles nothing.

Defined cases: a null or empty text or one without a letter (Unicode's categories L) is 'und' with score 0; rows whose
label or text is null are not learned from; without any such row everything is 'und'; an empty table gives an empty
table; a text of any length is read whole, in spans; extra columns are dropped by predict() except those in `keep`, and
one of these that has the name of a new column is an error that says so; repeated rows are predicted each for itself;
ties between languages go to the first by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import map_batches, new_names, pieces

SPAN = 64
HIDDEN = 8
TOGETHER = 4096
UNKNOWN = "und"
#: Letters, and a few numerals that has_letter() tells from them.
LETTER = re.compile(r"[^\W\d_]")
#: Bounds of what is learned from: documents of each label, characters of each of a document's three pieces, documents.
PER_LABEL, PIECE, MOST = 600, 160, 240_000


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


@dataclass
class Network:
    """labels, and the weights: for each direction, gate by gate (z, r, n), byte rows (256, h) and state (h, h)."""

    labels: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            for gate in "zrn":
                w[f"x{gate}{d}"] = rng.normal(0, 0.3, (256, hidden))
                w[f"u{gate}{d}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, hidden))
            w[f"v{d}"] = rng.normal(0, 0.3, (hidden, len(labels)))
        w["c"] = np.zeros((1, len(labels)))
        return cls(labels, {k: v.astype(np.float32) for k, v in w.items()})

    def states(self, data: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """data (span, n) bytes -> hidden states (span, n, h) from one end; trace gets what backpropagation needs."""
        w, (span, n) = self.weights, data.shape
        xz, xr, xn, uz, ur, un = (w[f"{k}{g}{d}"] for k in "xu" for g in "zrn")
        xz, xr, uz, ur = xz / 2, xr / 2, uz / 2, ur / 2  # a sigmoid is a tanh of half its argument
        out = np.empty((span, n, xz.shape[1]), np.float32)
        h = np.zeros((n, xz.shape[1]), np.float32)
        for t in range(span) if d == "f" else range(span - 1, -1, -1):
            b = data[t]
            z = np.take(xz, b, axis=0, mode="clip")
            z += h @ uz
            np.tanh(z, out=z)
            z *= 0.5
            z += 0.5
            r = np.take(xr, b, axis=0, mode="clip")
            r += h @ ur
            np.tanh(r, out=r)
            r *= 0.5
            r += 0.5
            m = h @ un
            a = r * m
            a += np.take(xn, b, axis=0, mode="clip")
            np.tanh(a, out=a)
            if trace is not None:
                trace.append((t, h, z, r, m, a))
            new = out[t]
            np.subtract(h, a, out=new)
            new *= z
            new += a
            h = new
        return out

    def probabilities(self, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
        """(labels, span, n): the label probabilities of every byte."""
        w, (span, n, hidden) = self.weights, hf.shape
        p = w["vf"].T @ hf.reshape(-1, hidden).T
        p += w["vb"].T @ hb.reshape(-1, hidden).T
        p += w["c"].T
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return p.reshape(len(self.labels), span, n)

    def gradients(self, data: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over the bytes in mask, by backpropagation through time."""
        w, (span, n) = self.weights, data.shape
        traces: dict[str, list] = {"f": [], "b": []}
        h = {d: self.states(data, d, traces[d]) for d in "fb"}
        p = self.probabilities(h["f"], h["b"])
        p[target, :, np.arange(n)] -= 1
        p *= mask / mask.sum()
        flat = p.reshape(len(self.labels), -1)
        grads = {"c": flat.sum(1)[None, :]}
        for d in "fb":
            hidden = h[d].shape[2]
            grads[f"v{d}"] = h[d].reshape(-1, hidden).T @ flat.T
            down = (flat.T @ w[f"v{d}"].T).reshape(span, n, hidden)
            sums = {g: np.zeros((hidden, hidden), np.float32) for g in "zrn"}
            into = {g: np.empty((span, n, hidden), np.float32) for g in "zrn"}
            dh = np.zeros((n, hidden), np.float32)
            for t, before, z, r, m, a in reversed(traces[d]):
                dh = dh + down[t]
                dn = dh * (1 - z) * (1 - a * a)
                dz = dh * (before - a) * z * (1 - z)
                dr = dn * m * r * (1 - r)
                dm = dn * r
                into["z"][t], into["r"][t], into["n"][t] = dz, dr, dn
                sums["z"] += before.T @ dz
                sums["r"] += before.T @ dr
                sums["n"] += before.T @ dm
                dh = dh * z + dz @ w[f"uz{d}"].T + dr @ w[f"ur{d}"].T + dm @ w[f"un{d}"].T
            flat_bytes = data.ravel()
            for g in "zrn":
                columns = into[g].reshape(-1, hidden)
                grads[f"x{g}{d}"] = np.stack([np.bincount(flat_bytes, columns[:, k], 256) for k in range(hidden)], 1)
                grads[f"u{g}{d}"] = sums[g]
        return grads


def spans(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into spans: bytes (SPAN, n), mask (SPAN, n), and the text of each span."""
    counts = np.array([-(-len(x) // SPAN) for x in data], np.int64)
    padded = b"".join([x.ljust(c * SPAN, b"\0") for x, c in zip(data, counts.tolist())])
    owner = np.repeat(np.arange(len(data)), counts)
    left = np.repeat(np.array([len(x) for x in data], np.int64), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    left -= (np.arange(len(owner)) - first[owner] if len(owner) else 0) * SPAN
    cells = np.frombuffer(padded, np.uint8).reshape(-1, SPAN)
    return cells, np.minimum(left, SPAN), owner


def train(texts: list[str], langs: list[str], hidden: int = HIDDEN, steps: int = 260, batch: int = 384, seed: int = 7) -> Network | None:
    """Adam over random batches of spans; every label is drawn equally often."""
    cells, length, owner = spans([t.encode() for t in texts])
    labels = sorted(set(langs))
    if not len(owner):
        return None
    net = Network.fresh(labels, hidden, seed)
    target = np.array([labels.index(x) for x in langs])[owner]
    rng = np.random.default_rng(seed)
    of = [np.flatnonzero(target == k) for k in range(len(labels))]
    of = [x for x in of if len(x)]
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, max(1, batch // len(of))) for x in of])
        mask = (np.arange(SPAN)[:, None] < length[pick][None, :]).astype(np.float32)
        grads = net.gradients(np.ascontiguousarray(cells[pick].T), mask, target[pick])
        rate = 0.03 * min(1.0, 1.6 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            move = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            net.weights[k] = (net.weights[k] - rate * move).astype(np.float32)
    return net


def predict_batch(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    kept = [i for i, t in enumerate(texts) if has_letter(t)]
    data = [texts[i].encode() for i in kept]
    total = np.zeros((len(net.labels), len(data)))
    cells, length, owner = spans(data)
    for at in range(0, len(owner), TOGETHER):
        part = np.ascontiguousarray(cells[at : at + TOGETHER].T)
        p = net.probabilities(net.states(part, "f"), net.states(part, "b"))
        p *= np.arange(SPAN)[:, None] < length[at : at + TOGETHER][None, :]
        sums, of = p.sum(1), owner[at : at + TOGETHER]
        base = of[0]
        for k in range(len(net.labels)):
            add = np.bincount(of - base, sums[k])
            total[k, base : base + len(add)] += add
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for j, i in enumerate(kept):
        best = int(total[:, j].argmax())
        lang[i], score[i] = net.labels[best], float(min(1.0, total[best, j] / len(data[j])))
    return lang, score


def fit(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL, piece: int = PIECE, most: int = MOST, seed: int = 7) -> Network | None:
    """A network learned from at most per_label documents of each label, of the rows where learn holds."""
    text, size = F.col(text_col), F.length(text_col)
    parts = F.concat_ws("\n", *[F.substring(text, F.lit(1) + (F.greatest(size - piece, F.lit(0)) * k / 2).cast("int"), F.lit(piece)) for k in range(3)])
    labelled = df.where(learn & F.col(label_col).isNotNull() & text.isNotNull())
    often = labelled.groupBy(F.col(label_col).alias("lang")).count().collect()  # the labels are the network's outputs
    if not often:
        return None
    per_label = max(1, min(per_label, most // len(often)))
    # the first by hash lie below this mark but for a chance that repeated rows raise, so a label's task sorts few rows at any size
    below = {r["lang"]: (3 * per_label + 100) / r["count"] * 2.0**64 - 2.0**63 for r in often}
    mark = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])[F.col("lang")]
    rows = labelled.select(F.col(label_col).alias("lang"), F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("order"), parts.alias("text"))
    first = Window.partitionBy("lang").orderBy("order", "text")
    sample = rows.where(F.col("order") <= mark).withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_label)
    picked = sample.collect()
    if lost := sorted(below.keys() - {r["lang"] for r in picked}):  # labels whose rows are copies of few, all above the mark
        picked += rows.where(F.col("lang").isin(lost)).groupBy("lang").agg(F.min("order").alias("order"), F.min_by("text", F.struct("order", "text")).alias("text")).collect()
    found = sorted((r["lang"], r["order"], r["text"]) for r in picked)
    return train([t for _, _, t in found], [x for x, _, _ in found], seed=seed)


def predict(df: DataFrame, net: Network | None, text_col: str = "text", keep: list[str] | None = None, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The columns in keep (all by default) with the predicted language and its probability."""
    keep = df.columns if keep is None else keep
    new_names(keep, lang_out, score_out)
    schema = StructType([*[df.schema[c] for c in keep], StructField(lang_out, StringType()), StructField(score_out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            texts = b.column(text_col).to_pylist()
            lang, score = ([UNKNOWN] * len(texts), [0.0] * len(texts)) if net is None else predict_batch(net, texts)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return map_batches(df.select(*dict.fromkeys([*keep, text_col])), run, schema)
