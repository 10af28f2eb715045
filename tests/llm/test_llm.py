"""Each operator on small frames: brute force, exact round trips, held-out accuracy, and the cases of the docstrings."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows_of

import corpus_pipeline
from bizframe.llm import bpe, chat, exact_dedup, langid, licenses, lm, media, minhash, mixing, queries, shingles, substrings
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, lang string, size long, label string, id long, keep_id long"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, s, "en", 1, "x", 5, 6) for i, t, s in rows], SCHEMA)


def simple(spark, texts):
    return frame(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(3)


ODD = [None, "", " \n ", "a", "É🙂", "word " * 3000, "same text", "same text", "x" * 5000]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cur = duck.execute(queries.ORACLE_SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


# Media


def test_png_filters_and_damage():
    rng = np.random.default_rng(0)
    want = rng.integers(0, 256, (11, 24), dtype=np.uint8)
    kinds = np.array([0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 2], np.uint8)
    rows, up = [], np.zeros(24, np.int32)
    for kind, row in zip(kinds, want.astype(np.int32)):
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], up[:-1]])
        p = left + up - corner
        near = np.stack([abs(p - left), abs(p - up), abs(p - corner)]).argmin(0)
        guess = [0 * row, left, up, (left + up) // 2, np.choose(near, [left, up, corner])][kind]
        rows.append((row - guess) & 255)
        up = row
    assert (media.unfilter(kinds, np.array(rows, np.uint8)) == want).all()
    png = media.encode_png(want.tobytes(), 24)
    assert (media.decode_png(png) == want).all()
    for bad in (png[:-1], png[:40] + bytes([png[40] ^ 1]) + png[41:], b"x" + png[1:]):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            media.decode_png(bad)


def test_media_round_trip(spark):
    df = simple(spark, ODD).select("doc_id", "text", media.pad_bytes(F.col("text")).alias("p"))
    for r in media.from_media(media.to_media(df, "p"), keep=["doc_id", "text"]).collect():
        data = (r["text"] or "").encode()
        size = max(1, -(-len(data) // 576)) * 576
        assert bytes(r["payload"]) == data.ljust(size, b"\xff") and len(r["feature"]) == 16
    assert media.to_media(df.where("false"), "p").count() == 0
    image = np.tile(np.linspace(0, 200, 576).astype(np.uint8), (64, 1))
    shifted = media.cosine_hash(np.clip(image.astype(int) + 10, 0, 255).astype(np.uint8))
    assert sum(bin(a ^ b).count("1") for a, b in zip(media.cosine_hash(image), shifted)) <= 8


# BPE


def test_bpe_is_the_library(spark, sf):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = ["<|endoftext|>", "A", "Σ", "É", "é", "  ", "\n", "'s", "'RE", "12", "!!", "İ", "日本", "\x1c", "\x85", "<|", "x" * 70, "heLLo", "ab!" * 40]
    texts = [*ODD, *["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(300)]]
    df = simple(spark, texts)
    got = bpe.decode(bpe.encode(df, path), path).collect()
    plain = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in got}
    packed = {r["doc_id"]: list(np.frombuffer(r["ids"], "<u4")) for r in bpe.encode(df, path, packed=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert plain[i] == (ids, library.decode(ids, skip_special_tokens=False)) and packed[i] == ids


def test_bpe_cuts_only_where_nothing_joins():
    v = bpe.vocabulary(queries.tokenizer_path())
    for word in ("internationalization", "zqxjkvb", "é" * 80):
        data = np.frombuffer(word.encode(), np.uint8).astype(np.int64)
        data[-1] += 256
        parts = v.first[data]
        whole, _ = v.merge(parts, np.zeros(len(parts), np.int32))
        assert v.encode_words([word]) == [whole.astype("<u4").tobytes()] and whole.tolist() == v.merge_long(parts.tolist())


def test_bpe_defined_cases(spark):
    path = queries.tokenizer_path()
    empty = frame(spark, [])
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0
    rows = bpe.decode(bpe.encode(frame(spark, [(1, "same words", "s")] * 3 + [(2, "a" * 300_000, "s"), (3, "The end. " * 40_000, "s")]), path, packed=True), path).collect()
    assert len({(bytes(r["ids"]), r["decoded"]) for r in rows if r["doc_id"] == 1}) == 1 and {r["source"] for r in rows} == {"s"}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    for r in rows:
        text = {1: "same words", 2: "a" * 300_000, 3: "The end. " * 40_000}[r["doc_id"]]
        assert list(np.frombuffer(r["ids"], "<u4")) == library.encode(text, add_special_tokens=False).ids
    ids = spark.createDataFrame([([5, 10**8, 6],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(ids, path).collect()] == [library.decode([5, 6], skip_special_tokens=False), None, ""]
    with pytest.raises(ValueError):
        bpe.encode(empty.withColumnRenamed("label", "ids"), path)


# Language model


def test_lm_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    df = docs.unionByName(spark.createDataFrame([(900, None, "en"), (901, "", None), (902, "QZQZ the", "fr"), (902, "QZQZ the", "fr"), (None, "of", "en")], docs.schema))
    rows = df.collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in {r["doc_id"] for r in rows} if i is not None}
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter(w for r in rows if not held.get(r["doc_id"]) for w in tokens(r["text"]))
    total, distinct = sum(count.values()), len(count)
    got = lm.score(df, queries.remainder(7) == 2, class_col="lang").collect()
    assert len(got) == len(rows)
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        own = tokens(text[r["doc_id"]])
        base = sum(np.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["train_tokens"] == total and r["n_tokens"] == len(own)
        assert r["n_known"] == sum(count[w] > 0 for w in own) and r["score"] < 0 and r["held_out"] == bool(held.get(r["doc_id"]))
    sums = lambda name, h: sum(r[name] for r in got if r["held_out"] == h)
    assert sums("score", False) > sums("base_score", False)
    assert lm.score(df.where("false"), F.lit(True)).count() == 0


def test_lm_spelling_is_a_distribution():
    words = [b"the", b"then", b"them", b"her"]
    size = int(lm.FIRST[-1])
    zeros, ones = np.zeros(size, np.float32), np.zeros(size, np.float32)
    bits = lm.Bits(words)
    for b in range(8):
        for s in bits.slots(b):
            np.add.at(zeros, s, 1 - bits.bit(b))
            np.add.at(ones, s, bits.bit(b))
    m = lm.learn(zeros, ones, words)
    one_byte = [bytes([c]) for c in range(256) if c != 32]
    assert (10 ** m.spell(one_byte)).sum() < 1
    assert m.spell([b"the"])[0] > m.spell([b"xqz"])[0]


def test_lm_learns_from_every_word(spark):
    words = sorted({bytes(random.Random(k).choices(b"abcdefgh", k=1 + k % 9)) for k in range(500)})
    table = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").repartition(5)
    counts = lm.slot_counts(table)
    weights, refine = lm.begun()
    shared = spark.sparkContext.broadcast(counts)
    several = lm.lessons(table, shared, weights, refine, 7)
    _, used, tried, won = np.split(several, np.cumsum([weights.size, lm.GATES, len(refine)]))
    bits = 8 * sum(len(w) + 1 for w in words)
    assert used.sum() == bits and tried.sum() == bits
    assert won.sum() == sum(int(c).bit_count() for w in words for c in w + b" ")
    assert (several == lm.lessons(table.repartition(2), shared, weights, refine, 7)).all()
    m = lm.learned(table, *counts, len(words), together=100)
    assert (m.weights != weights).any(1)[used > 0].mean() > 0.9


# Mixing


def brute_apportion(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
        got[i] += 1
    return got


def test_apportion_is_highest_quotient(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(12):
        votes = [rng.choice([0, 1, 5, rng.randint(1, 1000)]) for _ in range(rng.randint(1, 15))]
        votes[0] = max(votes[0], 3)
        seats = rng.randint(0, 60)
        want |= {(g, i): q for i, q in enumerate(brute_apportion(votes, seats)) if votes[i]}
        rows += [(g, i, v, sum(votes), seats) for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, i int, v long, t long, s long")
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.apportion(df, ["g"], ["i"], "v", "t", "s").collect()}
    assert got == want


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(["w"] * rng.randint(1, 400)), rng.choice(["a"] * 8 + ["b", "c", None])) for i in range(600)]
    docs += [(1000, None, "a"), (1001, "", "b"), (1002, "one two", "d")]
    df = frame(spark, docs).repartition(4)
    how = {"weights": [3.0, 1.0, 2.0], "share": 1.5}
    got = mixing.mix(df, **how).collect()
    again = mixing.mix(df.repartition(2), **how).collect()
    assert sorted((r["doc_id"], r["__taken"]) for r in got) == sorted((r["doc_id"], r["__taken"]) for r in again)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["__size"]
        taken[r["source"]] += r["__taken"]
        target[r["source"]] = r["__target"]
        assert 0 <= r["__taken"] <= 2 * r["__size"]
    order, weights = ["a", "b", "c", "d", None], dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    total, room, want = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = (total - sum(want.values())) / sum(weights[s] for s in room)
        full = {s for s in room if weights[s] * level > 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] for s in full}
        room -= full
        if not full:
            want |= {s: weights[s] * level for s in room}
            break
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(32, 0.03 * want[s])
    rows = mixing.mix_documents(df, **how)
    assert rows.columns == df.columns and max(Counter(r["doc_id"] for r in rows.collect()).values()) == 2
    assert mixing.mix(df.where("false"), **how).count() == 0


# Near-duplicates


def brute_classes(texts, similarity=0.8):
    bags = []
    for t in texts:
        w = (t or "").lower().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())

    def alike(a, b):
        if not a or not b:
            return not a and not b
        return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in set(a) | set(b)) for i in a if i in b) >= similarity - 1e-12

    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and alike(bags[i], bags[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = list(ODD)
    for _ in range(10):
        base = rng.choices(words, k=rng.choice([6, 40, 150]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy).upper())
    df = simple(spark, texts)
    got = {r["doc_id"]: r for r in minhash.mark_near_duplicates(df).collect()}
    want = brute_classes(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["class_size"] == want.count(want[i]) and got[i]["kept"] == (want[i] == i) for i in got)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(want)
    odd = frame(spark, [(None, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "a b c d e f", "s")])
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in minhash.mark_near_duplicates(odd).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True)]
    assert minhash.mark_near_duplicates(df.where("false")).count() == 0


def test_large_bucket(spark):
    """More copies of one text than are compared in pairs, and outsiders that are near it but not near enough."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for k in range(90):
        copy = list(base)
        for p in rng.sample(range(200), 3 if k % 3 else 9):
            copy[p] = f"n{k}_{p}"
        texts.append(" ".join(copy))
    got = {r["doc_id"]: r["class_id"] for r in minhash.mark_near_duplicates(simple(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_buckets_of_several_blocks(spark, monkeypatch):
    """Buckets that are cut into many blocks find what a single block finds."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "FEW", 4)
    monkeypatch.setattr(minhash, "PIECE", 3000)
    core, drift = [f"c{i}" for i in range(60)], [f"d{i}" for i in range(900)]
    texts = [" ".join(core + drift[8 * i : 8 * i + 60]) for i in range(70)] + [" ".join(core + [f"o{k}_{i}" for i in range(30)] + [e]) for k in range(15) for e in ("x", "y")]
    random.Random(8).shuffle(texts)
    df, how = simple(spark, texts), {"bands": 2, "rows": 1}
    want, largest = classes_by_bands(df, texts, **how)
    assert largest > minhash.BLOCK * 2
    got = {r["id"]: r["class_id"] for r in minhash.classes(df, **how).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_similarities_are_the_exact_ones():
    rng = random.Random(9)
    data = [" ".join(rng.choices("abcdef", k=rng.randint(0, 30))).encode() for _ in range(60)] + [" ".join(f"w{rng.randint(0, 60)}" for _ in range(40)).encode() for _ in range(40)]
    found = shingles.weighted(*shingles.shingle_hashes(data))
    bag = lambda i: tuple(x[found[0] == i] for x in found[1:])
    a, b = np.array([rng.randrange(100) for _ in range(800)]), np.array([rng.randrange(100) for _ in range(800)])
    got = shingles.similarities(a, b, 100, *found)
    assert got == pytest.approx([shingles.probability_jaccard(bag(x), bag(y)) for x, y in zip(a, b)])


def classes_by_bands(df, texts, **how):
    """Classes by comparing all pairs that share a band."""
    keys = {r["id"]: list(r["keys"]) for r in minhash.sketches(df, **how).collect()}
    bags = [minhash.weighted(*shingles.shingle_hashes([t.lower().encode()]))[1:] for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            meet = any(x == y for x, y in zip(keys[i], keys[j]))
            if meet and label[i] != label[j] and shingles.probability_jaccard(bags[i], bags[j]) >= 0.8 - 1e-12:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label, max(Counter((b, k) for x in keys.values() for b, k in enumerate(x)).values())


def test_chain_in_one_bucket(spark):
    """Each text is near the next ones only: most are near members of the pivot's class and not near the pivot."""
    core, drift = [f"c{i}" for i in range(100)], [f"d{i}" for i in range(1000)]
    texts = [" ".join(core + drift[9 * i : 9 * i + 70]) for i in range(100)]
    random.Random(6).shuffle(texts)
    df, how = simple(spark, texts), {"bands": 1, "rows": 1}
    want, largest = classes_by_bands(df, texts, **how)
    assert largest > minhash.FEW
    got = {r["id"]: r["class_id"] for r in minhash.classes(df, **how).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_outsiders_of_one_template(spark):
    """Pairs of near copies that are too far from all others, in buckets that most texts of the template share."""
    rng, core = random.Random(7), [f"c{i}" for i in range(100)]
    texts = []
    for k in range(60):
        own = [f"o{k}_{i}" for i in range(30)]
        texts += [" ".join(core + own), " ".join(core + own[:-1] + ["x"])]
    rng.shuffle(texts)
    df, how = simple(spark, texts), {"bands": 3, "rows": 1}
    want, largest = classes_by_bands(df, texts, **how)
    assert largest > minhash.FEW and len(set(want)) < len(texts) * 2 // 3
    got = {r["id"]: r["class_id"] for r in minhash.classes(df, **how).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_sketch_estimates(spark):
    a, b = " ".join(f"x{i}" for i in range(400)), " ".join(f"x{i}" for i in range(100, 480))
    owner, hashes, weight = shingles.weighted(*shingles.shingle_hashes([a.encode(), b.encode()]))
    s = minhash.sketch(owner, hashes, weight, 2, 2000)
    side = lambda k: (hashes[owner == k], weight[owner == k])
    assert abs((s[0] == s[1]).mean() - shingles.probability_jaccard(side(0), side(1))) < 0.05


# Chat


def test_preferences(spark):
    turns = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "no"), (1, False, 2, "user", None),
        (2, True, 0, "user", "x"), (3, True, 0, "user", "s"), (3, False, 0, "user", "s"), (None, True, 0, "user", "z"),
    ]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "p int, c boolean, turn int, role string, text string, prompt string")
    got = {r["p"]: r for r in chat.format_preferences(df, "p", "c").collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["prompt_turns"] == 1
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["yes<|end|>\n"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_mask"]] == ["no<|end|>\n"]
    assert got[2]["rejected"] == "" and got[2]["prompt"] == "" and got[3]["chosen"] == "" and got[3]["chosen_mask"] == []


# Language ID


def test_gradients():
    net = langid.Network.fresh(["a", "b", "c"], 5, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(0)
    data, mask, target = rng.integers(0, 256, (6, 4)).astype(np.uint8), np.ones((6, 4)), np.array([0, 1, 2, 1])
    mask[4:, 1] = 0

    def loss():
        p = net.probabilities(net.states(data, "f"), net.states(data, "b"))
        return (-np.log(p[target, :, np.arange(4)].T) * mask).sum() / mask.sum()

    grads = net.gradients(data, mask, target)
    for k, v in net.weights.items():
        for i in list(np.ndindex(v.shape))[:: max(1, v.size // 12)]:
            old = v[i]
            v[i] = old + 1e-2
            up = loss()
            v[i] = old - 1e-2
            down = loss()
            v[i] = old
            assert grads[k][i] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = langid.fit(docs, queries.remainder(5) != 0, per_label=100)
    said = langid.predict(docs.where(queries.remainder(5) == 0), net, keep=["lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in said]) > 0.9
    odd = langid.predict(simple(spark, [*ODD, "123 !?"]), net, keep=["doc_id"]).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert [got[i] for i in (0, 1, 2, 9)] == ["und"] * 4 and got[3] != "und"
    assert all(0 <= r["score"] <= 1 for r in odd)
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, none, keep=["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs.where("false"), net, keep=["doc_id"]).count() == 0


# Exact dedup


def test_exact(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(6, "same text", "s"), (None, "nobody", "s"), (None, "a", "s")]
    df = frame(spark, rows).repartition(3)
    got = exact_dedup.mark_duplicates(df, keep="largest").collect()
    assert len(got) == len(rows)
    size = Counter((t or "") for _, t, _ in rows)
    best = {}
    for i, t, _ in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    for r in got:
        t = digest[r["text_sha256"]]
        assert r["group_size"] == size[t] and (-1 if r["keep_id"] is None else r["keep_id"]) == best[t]
    kept = exact_dedup.drop_duplicates(df, keep="largest")
    assert kept.columns == df.columns and sorted((r["text"] or "") for r in kept.collect()) == sorted(size)
    assert {r["doc_id"] for r in exact_dedup.drop_duplicates(df).where("text = 'same text'").collect()} == {6}
    assert exact_dedup.mark_duplicates(df.where("false")).count() == 0


# Licences


def test_licenses(spark):
    words = licenses.TEMPLATES["apache-2"].split()
    fuzzy = " ".join([*words[:8], "inserted", *words[8:20], *words[21:]])
    texts = [None, "", "cc", "Under the MIT License, under the mit\nlicense", "x CC-BY-NC y", "apache license version 20", fuzzy, "under the mit " * 5000, "no license: ünder the mit license"]
    got = {r["doc_id"]: r for r in licenses.label_documents(simple(spark, texts)).collect()}
    pick = lambda i: tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))
    assert pick(0) == pick(1) == (0, 0, None, None, "")
    assert pick(3) == (8, 2, 0, 4, "mit") and got[3]["score"] == 1.0
    assert pick(4) == (5, 1, 1, 1, "cc-by-nc") and pick(5) == (4, 0, None, None, "")
    assert got[6]["labels"] == "apache-2" and got[6]["score"] > 0.6
    assert pick(7)[1] == 0 and pick(8)[:2] == (6, 0)
    assert licenses.label_documents(simple(spark, texts).where("false")).count() == 0


# Repeated strings


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1])), kept)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("ab \né", k=rng.randint(50, 400))) for _ in range(8)] + ["x" * 300, "abc" * 90]
    rows = []
    for i in range(100):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh ", k=rng.randint(0, 200))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)[rng.randint(0, 40) :]))
    rows += [(500, None), (501, ""), (502, "q" * 99), (503, "q" * 100), (504, "q" * 101), (None, "q" * 300)]
    rng.shuffle(rows)
    df = frame(spark, [(i, t, "s") for i, t in rows]).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(df).collect()}
    assert got.pop(None) == (300, 0, 0, b"q" * 300)
    assert got == brute_repeats(rows)


def test_repeated_rows_do_not_remove_each_other(spark):
    df = frame(spark, [(1, "z" + "ab c" * 20 + "y" * 50, "s")] * 3)
    assert {r["n_removed"] for r in substrings.remove_repeats(df).collect()} == {0}
    assert substrings.remove_repeats(df.where("false")).count() == 0


# Pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    words = ["der", "und", "haus", "katze", "the", "and", "house", "cat"]
    text = lambda lo, n: " ".join(rng.choice(words[lo : lo + 4]) + rng.choice("abcdefgh") for _ in range(n))
    docs = [(i, text(4 * (i % 2), 60 + i), ["de", "en"][i % 2], f"s{i % 3}") for i in range(40)]
    docs += [(100, docs[0][1], "de", "s0"), (101, docs[1][1] + " more", "en", "s0"), (102, "123 456", None, "s0"), (103, None, None, None)]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = current.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path)).cache()
        assert current.columns == columns
        ids.append({r["doc_id"] for r in current.collect()})
    assert ids[0] == {d[0] for d in docs} - {102, 103}
    assert ids[1] == ids[0] - {0}
    assert ids[2] == ids[1] - {101} and ids[3] <= ids[2]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in current.collect())
    v = bpe.vocabulary(queries.tokenizer_path())
    by_id = {d[0]: d[1] for d in docs}
    for r in out[:20]:
        ids_ = v.encode([by_id[r["doc_id"]]])[0]
        assert r["n_tokens"] * 4 == len(ids_) and r["ids_sha256"] == hashlib.sha256(ids_).hexdigest()


def test_lm_lessons_look_up_what_a_slot_says_without_the_words_own_count():
    rng = np.random.default_rng(4)
    words = sorted({bytes(rng.integers(97, 103, rng.integers(1, 7)).astype(np.uint8)) for _ in range(300)} | {b"\n", "é".encode()})
    bits = lm.Bits(words)
    zeros, ones = np.zeros((2, int(lm.FIRST[-1])), np.float32)
    for b in range(8):
        for s in bits.slots(b):
            np.add.at(zeros, s[bits.bit(b) == 0], 1)
            np.add.at(ones, s[bits.bit(b) == 1], 1)
    stretched, level = lm.apart(zeros, ones)
    for b in range(8):
        bit = bits.bit(b)
        for s in bits.slots(b):
            z, o = zeros[s] - (1 - bit), ones[s] - bit
            assert np.array_equal(stretched[2 * s + bit], lm.stretch(z, o))
            assert np.array_equal(level[s], np.digitize(z + o, lm.LEVELS))
    m = lm.Mixer(None, None, *lm.begun())
    used, tried, won = lm.taught(m, stretched, level, words, 800, 0.02)
    assert used.sum() == tried.sum() == 8 * len(bits.byte) and won.sum() == sum(bits.bit(b).sum() for b in range(8))


def test_lm_stretches_counts_of_any_type_alike():
    zeros, ones = np.random.default_rng(1).integers(0, 500, (2, 4096))
    want = lm.stretch(zeros, ones)
    assert np.array_equal(want, lm.stretch(zeros.astype(np.float32), ones.astype(np.float32)))
    assert all(lm.stretch(zeros[k : k + 1], ones[k : k + 1])[0] == want[k] for k in range(0, 4096, 7))
