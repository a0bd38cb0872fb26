"""The registered queries of the text operators and the SQL that they are held against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from curralis.llm import exact_dedup, line_dedup, near_dedup, packing, pii, quality, sentencepiece_codec, sharding, topk, warc
from curralis.llm.common import table

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"
#: Key of the registered query only; callers of the operator pass their own secret.
PII_KEY = "registered-query"


def op1_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities")


def op4_sharding(spark, sf_dir):
    placed, _ = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op5_topk(spark, sf_dir):
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5)


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), width=3, num=85)


def op7_line_dedup(spark, sf_dir):
    return line_dedup.drop_repeated_chunks(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op8_packing(spark, sf_dir):
    packed, _ = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return packed


def op9_sentencepiece(spark, sf_dir):
    coded = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.QualityModel.fit(docs, labels.filter(~quality.held_out()))
    return model.score(docs.select("doc_id", "text")).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_exact_dedup, op3_pii, op4_sharding, op5_topk, op6_near_dedup, op7_line_dedup, op8_packing, op9_sentencepiece, op10_quality)}

ORACLES = {
    "op5_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        h AS (SELECT payload_digest, min(page_id) AS head FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN h.head IS NULL OR h.head = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN h.head <> d.page_id THEN h.head END AS refers_to
        FROM d LEFT JOIN h USING (payload_digest)""",
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op6_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
        k AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM k LEFT JOIN n USING (doc_id)""",
    "op7_line_dedup": r"""
        WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l, sha256(text) AS dg FROM documents),
        x AS (SELECT doc_id, dg, l, unnest(range(1, len(l) + 1)) AS i FROM d),
        h AS (SELECT doc_id, dg, l, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM x WHERE regexp_matches(l[i], '\S')),
        w AS (SELECT doc_id, dg, i AS s, nx AS e, array_to_string(l[i:nx], chr(10)) AS body FROM h WHERE nx IS NOT NULL
              UNION ALL SELECT doc_id, dg, i, i, l[i] FROM h WHERE len(regexp_extract_all(l[i], '\S+')) >= 50),
        f AS (SELECT body, min({'doc_id': doc_id, 'dg': dg, 's': s, 'e': e}) AS f FROM w GROUP BY body HAVING count(*) > 1),
        c AS (SELECT w.doc_id, CASE WHEN w.doc_id = f.doc_id THEN greatest(w.s, f.e + 1) ELSE w.s END AS s, w.e FROM w JOIN f USING (body)),
        g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM c WHERE s <= e),
        k AS (SELECT x.doc_id, string_agg(x.l[x.i], chr(10) ORDER BY x.i) AS text FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id) AS n_removed FROM d LEFT JOIN k USING (doc_id)""",
}
