"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import align, bpe, chat, exact_dedup, filter_audit, langid, licenses, lm, media, minhash, mixing, substrings, toxicity
from .common import table, whole_text

#: The vocabulary's place is a parameter; it is never copied.
TOKENIZER = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    padded = docs.select(
        "doc_id",
        F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long").alias("n_bytes"),
        media.pad_bytes(F.col("text")).alias("payload"),
    )
    back = media.from_media(media.to_media(padded, "payload"), keep=["doc_id", "n_bytes"])
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digest(docs)


def bpe_digest(docs: DataFrame) -> DataFrame:
    return bpe.round_trip(docs, tokenizer_path()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), remainder(7) == 2, class_col="lang")


#: Production parameters of the mix.
MIX = {"weights": [3.0, 1.0, 2.0], "share": 1.5, "max_repeat": 2, "seed": 0}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.text_size().alias("words"))
    return mixing.mix(docs, size=F.col("words"), **MIX).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken")
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.mark_near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is chosen; what is rejected begins with its first conv_id % (turns + 1) turns and goes on as the
    next conversation does from there, so that prefixes have all lengths from none to all of a side."""
    own = Window.partitionBy("conv_id")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "role", "text", F.row_number().over(own.orderBy("turn", "role", "text")).alias("n"), (F.col("conv_id") % (F.count(F.lit(1)).over(own) + 1)).alias("k")
    )
    cuts = turns.where("n = 1").select(F.col("conv_id").alias("pair_id"), (F.col("conv_id") + 1).alias("conv_id"), "k")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit(True).alias("chosen"), F.col("n").alias("turn"), "role", "text")
    begins = turns.where("n <= k").select(F.col("conv_id").alias("pair_id"), F.lit(False).alias("chosen"), F.col("n").alias("turn"), "role", "text")
    ends = turns.drop("k").join(cuts, "conv_id").where("n > k").select("pair_id", F.lit(False).alias("chosen"), F.col("n").alias("turn"), "role", "text")
    out = chat.format_preferences(chosen.unionByName(begins).unionByName(ends), "pair_id", "chosen")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return out.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


def remainder(n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(5) == 0)
    net = langid.fit(docs, ~F.col("held_out"))
    return langid.predict(docs, net, keep=["doc_id", "held_out"])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label_documents(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), *map(tokenizer_path, ALIGNED), keep=["doc_id"])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = filter_audit.text_filters(whole_text())
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    cells = filter_audit.mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), filters, F.col("lang"), flags)
    return filter_audit.audit(cells, "".join(filters) + filter_audit.COPIES, list(flags))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(5) == 0).alias("held_out"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


QUERIES = {
    "op1_media": op1_media,
    "op2_bpe": op2_bpe,
    "op3_lm": op3_lm,
    "op4_mixing": op4_mixing,
    "op5_minhash": op5_minhash,
    "op6_chat": op6_chat,
    "op7_langid": op7_langid,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_licenses": op9_licenses,
    "op10_substrings": op10_substrings,
    "op11_align": op11_align,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity": op13_toxicity,
}


def _grams_sql() -> str:
    """The licence templates' k-grams as SQL values."""
    rows = licenses.gram_rows(licenses.PHRASES, licenses.TEMPLATES, licenses.K)
    return ", ".join(f"('{g}', '{t}', '{label}', {base}, {i}, {n})" for g, t, label, base, i, n in rows)


ORACLE_SQL = {
    "op4_mixing": r"""
        WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        w AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
                     (sum(sum(size)) OVER ())::DOUBLE * 1.5 AS mix FROM s GROUP BY source),
        v AS (SELECT *, (mix - coalesce(sum(source_size * 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM w WINDOW o AS (ORDER BY source_size * 2 / w, source NULLS LAST)),
        t AS (SELECT source, source_size, mix, coalesce(source, '') || (source IS NULL)::VARCHAR AS key, round(mix / 32)::BIGINT AS blocks, greatest(1, ceil(sqrt(source_size / 512)))::BIGINT AS shards,
                     least(source_size * 2, w * (SELECT arg_min(level, source_size * 2 / w) FROM v WHERE level * w <= source_size * 2))::DOUBLE AS target FROM v),
        won AS (SELECT key, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS rank, blocks
                FROM (SELECT *, unnest(range((target * blocks / mix)::BIGINT + (SELECT count(*) FROM t))) AS k FROM t WHERE target > 0)),
        quota AS (SELECT key, count(*) AS q FROM won WHERE rank <= blocks GROUP BY 1),
        d AS (SELECT s.*, t.key, t.source_size, t.target, coalesce(q, 0) AS q, (((doc_id % 2147483648) * 2654435761 % 4294967296) // 65536) % shards AS shard
              FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN quota USING (key)),
        g AS (SELECT key, shard, sum(size)::BIGINT AS votes, any_value(source_size) AS total, any_value(q) AS q FROM d GROUP BY 1, 2),
        won2 AS (SELECT key, shard, row_number() OVER (PARTITION BY key ORDER BY votes / (2 * k + 1) DESC, shard) AS rank, q
                 FROM (SELECT *, unnest(range((votes * q / total)::BIGINT + (SELECT max(shards) FROM t))) AS k FROM g WHERE votes > 0)),
        quota2 AS (SELECT key, shard, count(*) AS n FROM won2 WHERE rank <= q GROUP BY 1, 2),
        laid AS (SELECT d.*, coalesce(n, 0) * 32 AS words, sum(size) OVER (PARTITION BY key, shard) AS span,
                        coalesce(sum(size) OVER (PARTITION BY key, shard ORDER BY md5('0:' || doc_id), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                 FROM d LEFT JOIN quota2 USING (key, shard)),
        p AS (SELECT *, CASE WHEN span > 0 THEN words // span ELSE 0 END AS passes FROM laid)
        SELECT doc_id, size, source_size, target, least(passes * size + least(size, greatest(0, words - passes * span - before)), size * 2)::BIGINT AS taken FROM p
    """,
    "op9_licenses": r"""
        WITH known(gram, template, label, base, t_pos, t_grams) AS (VALUES """ + _grams_sql() + r"""),
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        grams AS (SELECT doc_id, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram, i AS pos FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM w)),
        diagonals AS (SELECT doc_id, template, label, base, t_grams, pos - t_pos AS diagonal, list(DISTINCT t_pos) AS covered FROM grams JOIN known USING (gram) GROUP BY ALL),
        runs AS (SELECT *, sum(CASE WHEN diagonal - last > 4 OR last IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run
                 FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS last FROM diagonals WHERE NOT base)),
        chain AS (SELECT *, t_pos > coalesce(max(t_pos) OVER (PARTITION BY doc_id, template, run ORDER BY diagonal + t_pos, t_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS on_chain
                  FROM (SELECT *, unnest(covered) AS t_pos FROM runs)),
        spans AS (SELECT doc_id, label, base, diagonal AS start, 1.0 AS cover FROM diagonals WHERE base AND len(covered) = t_grams
                  UNION ALL SELECT doc_id, label, false, min(diagonal), count(*) FILTER (on_chain) / any_value(t_grams) FROM chain GROUP BY doc_id, template, label, run
                  HAVING count(*) FILTER (on_chain) / any_value(t_grams) >= 0.6),
        found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM spans GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM w LEFT JOIN found USING (doc_id)
    """,
    "op6_chat": """
        WITH c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
                          conv_id % (count(*) OVER (PARTITION BY conv_id) + 1) AS k FROM conversations),
        u AS (SELECT conv_id AS pair_id, 0 AS side, role, text, n FROM c UNION ALL SELECT conv_id, 1, role, text, n FROM c WHERE n <= k
              UNION ALL SELECT o.conv_id, 1, c.role, c.text, c.n FROM c JOIN c o ON c.conv_id = o.conv_id + 1 AND o.n = 1 WHERE c.n > o.k),
        t AS (SELECT pair_id, side, role, text, n, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body FROM u),
        sizes AS (SELECT pair_id, coalesce(max(n) FILTER (side = 0), 0) AS c, coalesce(max(n) FILTER (side = 1), 0) AS r FROM t GROUP BY 1),
        differ AS (SELECT a.pair_id, min(a.n) AS n FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.n = b.n
                   WHERE coalesce(a.role, '') <> coalesce(b.role, '') OR coalesce(a.text, '') <> coalesce(b.text, '') GROUP BY 1),
        common AS (SELECT pair_id, coalesce(n - 1, least(c, r)) AS k FROM sizes LEFT JOIN differ USING (pair_id)),
        placed AS (SELECT t.*, k, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, side ORDER BY n) - length(body) AS here,
                          coalesce(sum(length(head) + length(body)) FILTER (n <= k) OVER (PARTITION BY pair_id, side), 0) AS shift
                   FROM t JOIN common USING (pair_id))
        SELECT pair_id, any_value(k) AS prompt_turns,
               coalesce(string_agg(head || body, '' ORDER BY n) FILTER (n <= k AND side = 0), '') AS prompt,
               coalesce(string_agg(head || body, '' ORDER BY n) FILTER (n > k AND side = 0), '') AS chosen,
               coalesce(string_agg(head || body, '' ORDER BY n) FILTER (n > k AND side = 1), '') AS rejected,
               coalesce(string_agg((here - shift)::BIGINT || '-' || (here - shift + length(body))::BIGINT, ',' ORDER BY n) FILTER (n > k AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
               coalesce(string_agg((here - shift)::BIGINT || '-' || (here - shift + length(body))::BIGINT, ',' ORDER BY n) FILTER (n > k AND side = 1 AND role = 'assistant'), '') AS rejected_mask
        FROM placed GROUP BY pair_id
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_filter_audit": r"""
        WITH RECURSIVE letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders AS (SELECT f AS o, bit AS used FROM letters UNION ALL SELECT o || f, used + bit FROM orders JOIN letters ON used & bit = 0 WHERE length(o) < 5),
        steps AS (SELECT o, s, f, bit, coalesce((SELECT sum(b.bit) FROM letters b WHERE instr(substr(o, 1, s - 1), b.f) > 0), 0)::INT AS before
                  FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders WHERE length(o) = 5) JOIN letters ON substr(o, s, 1) = f),
        flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
        d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
                     + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
              FROM d LEFT JOIN flags USING (doc_id)),
        cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
        r AS (SELECT part, o AS filter_order, s AS step, f,
                     sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                     sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                     sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                     sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                     sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                     sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
              FROM cells, steps GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
    """,
}
