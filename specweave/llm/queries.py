"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm import chat, collocations, decontaminate, html_main, infill, langid, packing, pii, quality, sharding, simhash, topk, toxicity
from specweave.llm.common import need, table

TOKENIZER = "word_bpe_49k.json"
SHARDS = 24


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.from_conversations(table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.TURN_SCHEMAS)


def op5_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op7_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.prepared(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("id % 50 = 0"), 5)


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_main.extract(pages, html_main.learn(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train_on_documents(docs)
    found = langid.identify(need(docs, ("doc_id", "text")), model, spans=False)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.samples(table(spark, sf_dir, "documents"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out()
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~out))
    return toxicity.score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "neighbours", "terms")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney_quality": op1_kneser_ney_quality,
    "op2_cgk_decontamination": op2_cgk_decontamination,
    "op3_simhash_gray_index": op3_simhash_gray_index,
    "op4_tool_call_linking": op4_tool_call_linking,
    "op5_ffd_packing": op5_ffd_packing,
    "op6_rendezvous_sharding": op6_rendezvous_sharding,
    "op7_mtree_topk": op7_mtree_topk,
    "op8_html_main_text": op8_html_main_text,
    "op9_pii_anchors": op9_pii_anchors,
    "op10_language_id": op10_language_id,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_toxicity": op13_toxicity,
}

#: DuckDB SQL where it can express an operator; the others are tested against
#: brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op4_tool_call_linking": """
        WITH t AS (SELECT *, 'call_' || turn AS id FROM conversations),
        calls AS (SELECT *, row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1 AS level FROM (
            SELECT *, turn % 2 || ':' || (turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn)) AS island
            FROM t WHERE role <> 'assistant')),
        linked AS (SELECT c.*, a.turn AS result_turn, a.text AS content
            FROM calls c LEFT JOIN t a ON a.role = 'assistant' AND a.conv_id = c.conv_id AND a.turn = c.turn + 1)
        SELECT conv_id, turn, id AS call_id, role AS name, CAST(level AS INTEGER) AS level, result_turn IS NOT NULL AS linked, result_turn,
            role IN ('system', 'user', 'tool') AND text <> '' AS valid,
            CASE WHEN role NOT IN ('system', 'user', 'tool') THEN 'unknown tool' WHEN text = '' THEN '$.text: length' END AS error,
            CAST(to_json({'arguments': {'text': text, 'turn': turn}, 'id': id, 'name': role, 'result': content}) AS VARCHAR) AS message
        FROM linked
        UNION ALL
        SELECT conv_id, turn, 'call_' || (turn - 1), NULL, NULL, false, turn, false, 'no open call',
            CAST(to_json({'id': 'call_' || (turn - 1), 'result': text}) AS VARCHAR)
        FROM t a WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = a.conv_id AND c.turn = a.turn - 1)""",
    "op7_mtree_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM e q JOIN e c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op11_phrase_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
        grams AS (SELECT lang, array_to_string(w[i:i + s], ' ') AS phrase, s + 1 AS size
            FROM places, (SELECT unnest([0, 1, 2, 3, 4]) AS s) WHERE i + s <= len(w)),
        f AS (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
        inner_ AS (SELECT DISTINCT a.lang, a.phrase FROM c a JOIN c b ON a.lang = b.lang AND b.size > a.size AND 100 * b.f >= 100 * a.f
            AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')),
        kept AS (SELECT * FROM c ANTI JOIN inner_ USING (lang, phrase)),
        cuts AS (SELECT kept.*, unnest(range(1, size)) AS k FROM kept),
        scores AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, h.f AS l, t.f AS r, n, k,
            CAST((1000::HUGEINT * cuts.f * n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
            FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(w[1:k], ' ')
            JOIN f t ON t.lang = cuts.lang AND t.phrase = array_to_string(w[k + 1:], ' ') JOIN total ON total.lang = cuts.lang),
        lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM lowest QUALIFY rank <= 2000""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS parts,
            sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        e AS (SELECT *, len(parts) - CASE WHEN t = '' OR right(t, 1) = chr(10) THEN 1 ELSE 0 END AS n,
            list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
        c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
                WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
        u AS (SELECT *, CASE lo WHEN 0 THEN '' WHEN n THEN t ELSE array_to_string(parts[1:lo], chr(10)) || chr(10) END AS p,
            CASE hi WHEN 0 THEN '' WHEN n THEN t ELSE array_to_string(parts[1:hi], chr(10)) || chr(10) END AS pm FROM c),
        v AS (SELECT *, substr(pm, length(p) + 1) AS m, substr(t, length(pm) + 1) AS s FROM u)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256 FROM v""",
}
