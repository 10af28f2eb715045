"""The registered queries without SQL, over whole tables, against brute force; and names that clash."""

import hashlib
import zlib

import pytest
from test_llm import brute_repeats, frame, shingles, simple

from bizframe.llm import bpe, langid, licenses, media, minhash, queries
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, sf, docs):
    got = queries.op1_media(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        data = (docs[r["doc_id"]] or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        png = media.encode_png(padded, 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), sha(padded))
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(padded[-32:]), len(png), sha(png))
        assert r["feature"] == media.cosine_hash(media.decode_png(png)).hex()


def test_op2(spark, sf, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    for r in queries.op2_bpe(spark, sf).collect():
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False).encode())


def test_op5_recall(spark, sf, docs):
    """Every document against all others: all similar pairs are in one class, and classes hold similar texts only."""
    got = {r["doc_id"]: r["class_id"] for r in queries.op5_minhash(spark, sf).collect()}
    ids = sorted(docs)
    bags = [shingles.weighted(*shingles.shingle_hashes([(docs[i] or "").lower().encode()]))[1:] for i in ids]
    label = list(range(len(ids)))
    for x in range(len(ids)):
        for y in range(x):
            if label[x] != label[y] and shingles.probability_jaccard(bags[x], bags[y]) >= 0.8 - 1e-12:
                low, high = sorted((label[x], label[y]))
                label = [low if k == high else k for k in label]
    assert [got[i] for i in ids] == [ids[k] for k in label]


def test_op7(spark, sf, docs):
    net = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"), queries.remainder(5) != 0)
    got = queries.op7_langid(spark, sf).collect()
    lang, score = langid.predict_batch(net, [docs[r["doc_id"]] for r in got])
    for r, want, s in zip(got, lang, score):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["lang_pred"] == want and r["score"] == pytest.approx(s, abs=1e-4)


def test_op10(spark, sf, docs):
    want = brute_repeats([(i, t, None) [:2] for i, t in docs.items()])
    for r in queries.op10_substrings(spark, sf).collect():
        n, removed, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, sha(kept))


def test_letters():
    assert [langid.has_letter(t) for t in (None, "", "½ ² ① 12", "_", "a", "½é", "日")] == [False] * 4 + [True] * 3


def test_every_label_is_learned(spark):
    rows = [(k, f"lang{k} " * 9, None) for k in range(30)]
    df = simple(spark, [t for _, t, _ in rows]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    net = langid.fit(df, F.lit(True), most=10)
    assert len(net.labels) == 30
    nulls = df.withColumn("text", F.when(F.col("doc_id") > 0, F.col("text")))
    assert len(langid.fit(nulls, F.lit(True), most=10).labels) == 29


def test_names_that_clash(spark):
    df = simple(spark, ["a b"])
    for run in (
        lambda: media.to_media(df.withColumnRenamed("label", "media"), "text"),
        lambda: media.from_media(df.withColumnRenamed("label", "Payload"), "text"),
        lambda: bpe.encode(df.withColumnRenamed("label", "IDS"), queries.tokenizer_path()),
        lambda: langid.predict(df.withColumnRenamed("label", "score"), None),
    ):
        with pytest.raises(ValueError, match="there already"):
            run()


def test_licences_in_order(spark):
    words = licenses.TEMPLATES["mit/whole"].split()
    halves = words[80:] + words[:80]
    texts = [" ".join(words), "Kind " + " ".join(words[:5] + ["x"] + words[5:]), " ".join(reversed(words)), " ".join(halves), "under the Kit license", "Under The MIT LICENSE"]
    got = {r["doc_id"]: r for r in licenses.label_documents(simple(spark, texts)).collect()}
    assert got[0]["labels"] == got[1]["labels"] == "mit" and got[0]["score"] == 1.0 and 0.9 < got[1]["score"] < 1.0
    assert got[2]["labels"] == "" and got[4]["n_base"] == 0 and got[5]["base_labels"] == "mit"
    repeated = licenses.label_documents(frame(spark, [(1, "under the mit license", "s"), (1, "cc by nc", "s"), (1, None, "s")])).collect()
    assert [r["base_labels"] for r in repeated] == ["cc-by-nc,mit"] * 3


def test_intermediate_tables_go(spark, tmp_path):
    from bizframe.llm.common import discard, materialize

    out = materialize(spark.range(5).toDF("x"), "gone", at_most=5)
    path = out.inputFiles()[0].rpartition("/")[0].removeprefix("file:").replace("///", "/")
    import os

    assert os.path.isdir(path) and out.count() == 5
    discard(out)
    assert not os.path.isdir(path)
    assert minhash.classes(simple(spark, ["a"] * 3)).count() == 3


@pytest.mark.parametrize("same_text", [False, True])
def test_labels_under_one_id_are_learned(spark, same_text):
    rows = [(1, "gleich" if same_text else f"wort{k} und mehr", "de") for k in range(3000)] + [(k, f"some words {k}", "en") for k in range(2, 52)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, F.lit(True)).labels == ["de", "en"]
    assert langid.fit(df.where("lang = 'de'").withColumn("lang", F.concat(F.lit("x"), F.pmod(F.hash("text"), F.lit(3)).cast("string"))), F.lit(True), most=1).labels


def test_op6_has_prefixes_of_all_lengths(spark):
    got = queries.op6_chat(spark, "/root/testdata/sf0.01").select("prompt_turns", F.length("chosen").alias("c"), F.length("rejected").alias("r")).collect()
    assert len({r["prompt_turns"] for r in got}) >= 4 and any(not r["c"] for r in got) and any(r["c"] and r["r"] for r in got)
