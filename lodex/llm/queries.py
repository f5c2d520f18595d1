"""The registered queries of this subpackage and, where SQL can say the same, their SQL.

Each applies its operator to its whole table with production parameters. What becomes of nulls, empty and very long texts,
ties, repeated rows, empty tables and columns with clashing names is said at the operator: packing.pack, mixing.mix,
toxicity.train and score, quality.train and grade, ann.search, lm.score, langid.train and predict, simhash.near_duplicates,
pii.train and find, exact.deduplicate. Rows with a null id are never learned from by op3, op4 and op7, and count as held out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.llm import ann, dialogue, divergence, exact, langid, lm, mixing, ordered, packing, pii, quality, simhash, toxicity
from lodex.llm.support import crc_remainder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are one piece of the end token; the rest is said at packing.pack."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null is a source of its own, last; null and empty texts have size 0; repeated rows are drawn one by one. The rest is said at mixing.mix."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose remainder isn't 0; scores all."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(crc_remainder("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_first_word", "worst_words", "worst_score")


def grades(labels: DataFrame) -> DataFrame:
    """0: junk; 1: sound but toxic; 2: sound."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))


def op4_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from graded rows whose remainder isn't 0; grades all. kept: not junk, likelier than not."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.train(docs, grades(labels.where(crc_remainder("doc_id", 5) != 0)))
    graded = quality.grade(docs.select("doc_id", "text"), model, at_least=1)
    return graded.select("doc_id", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= 0.5).alias("kept"))


def op5_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and zero vectors, and those with components that are null or not finite, take no part; ties go to the smaller id. The rest is said at ann.search."""
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-gram of the corpus counts; a document is scored by the counts of all others."""
    scored = lm.score(_read(spark, sf_dir, "documents"), order=3, alpha=0.4)
    return scored.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose remainder isn't 2; predicts all."""
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_remainder("doc_id", 4) != 2))
    return langid.predict(docs, model).select("doc_id", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have fingerprint zero and are linked like others; null ids come after all others. The rest is said at simhash.near_duplicates."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from the documents' own sure spans; it adds spans to those of the base rules. `spans` has a fifth kind, secret, after the others. The rest is said at pii.find."""
    docs = _read(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs), with_text=False).drop("redacted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts equal each other; null ids come after all others; of rows with the same id one stays. The rest is said at exact.deduplicate."""
    return exact.deduplicate(_read(spark, sf_dir, "documents")).drop("row")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by the remainder of crc32 of `conv_id:turn`; nulls are one space."""
    turns = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(x)) if c else F.lit(x) for c, x in (("conv_id", " "), ("", ":"), ("turn", " "))])
    turns = turns.withColumn("fault", F.crc32(name.cast("binary")) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return turns.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that have no turns left after the damage have zeros, no edits and the digest of nothing; the rest is said at dialogue.repair."""
    turns = _read(spark, sf_dir, "conversations")
    summary, repaired = dialogue.repair(damaged(turns))
    found = summary.join(dialogue.digests(repaired).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    every = turns.select(F.col("conv_id").alias("id")).distinct().join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls are empty; the rest is said at divergence.audit."""
    return divergence.audit(_read(spark, sf_dir, "documents"), least_docs=3, top=200)


def op13_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are the end token alone; the rest is said at ordered.pack_in_order."""
    return ordered.pack_in_order(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_source_mixing, op3_toxicity_mil, op4_quality_ordinal, op5_cross_polytope_ann, op6_stupid_backoff, op7_language_id, op8_simhash_near_dedup, op9_pii_boosted, op10_exact_dedup, op11_conversation_repair, op12_source_divergence, op13_ordered_packing)}

ORACLE_SQL = {
    "op6_stupid_backoff": r"""
        WITH l AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l),
        g AS (SELECT doc_id, i, w AS w3, lag(w) OVER d AS w2, lag(w, 2) OVER d AS w1 FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        u1 AS (SELECT doc_id, w3, count(*) AS c FROM g GROUP BY 1, 2),
        b1 AS (SELECT doc_id, w2, w3, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
        t1 AS (SELECT doc_id, w1, w2, w3, count(*) AS c FROM g WHERE w1 IS NOT NULL GROUP BY 1, 2, 3, 4),
        u AS (SELECT w3, sum(c) AS c FROM u1 GROUP BY 1),
        b AS (SELECT w2, w3, sum(c) AS c FROM b1 GROUP BY 1, 2),
        t AS (SELECT w1, w2, w3, sum(c) AS c FROM t1 GROUP BY 1, 2, 3),
        -- counts in the other documents
        uo AS (SELECT doc_id, w3, u.c - u1.c AS c FROM u1 JOIN u USING (w3)),
        bo AS (SELECT doc_id, w2, w3, b.c - b1.c AS c FROM b1 JOIN b USING (w2, w3)),
        tt AS (SELECT doc_id, w1, w2, w3, t.c - t1.c AS c FROM t1 JOIN t USING (w1, w2, w3)),
        n AS (SELECT doc_id, (SELECT count(*) FROM e) - len(ws) AS c FROM l),
        s AS (SELECT g.doc_id,
                CASE WHEN tt.c >= 1 THEN log10(tt.c) - log10(p.c)
                     WHEN bo.c >= 1 THEN log10(bo.c) - log10(v.c) + CASE WHEN tt.c IS NULL THEN 0 ELSE log10(0.4) END
                     ELSE log10(greatest(uo.c, 0.5)) - log10(greatest(n.c, 1)) + CASE WHEN tt.c IS NOT NULL THEN 2 WHEN bo.c IS NOT NULL THEN 1 ELSE 0 END * log10(0.4) END AS x
              FROM g JOIN uo USING (doc_id, w3) JOIN n USING (doc_id)
                LEFT JOIN bo ON g.doc_id = bo.doc_id AND g.w2 = bo.w2 AND g.w3 = bo.w3 LEFT JOIN tt ON g.doc_id = tt.doc_id AND g.w1 = tt.w1 AND g.w2 = tt.w2 AND g.w3 = tt.w3
                LEFT JOIN uo v ON g.doc_id = v.doc_id AND g.w2 = v.w3 LEFT JOIN bo p ON g.doc_id = p.doc_id AND g.w1 = p.w2 AND g.w2 = p.w3)
        SELECT l.doc_id, any_value(len(ws))::BIGINT AS n_words, round(coalesce(sum(x), 0.0), 4) AS log10_score
        FROM l LEFT JOIN s ON l.doc_id = s.doc_id GROUP BY l.doc_id""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        h AS (SELECT *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT), lambda c, b: list_reduce(range(8), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295) % 20 AS fault FROM n),
        d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
        o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || chr(0) || text)) AS i FROM d),
        f AS (SELECT *, left(role, 1) AS r, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
                     NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        t AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
                     count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        -- came last: 0 nothing, 1 system, 2 user, 3 assistant; ins: turns put in, and what came last then
        ins AS (SELECT * FROM (VALUES (0, 0, 0, []), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
                                      (2, 0, 2, []), (2, 1, 3, ['assistant:']), (3, 0, 3, []), (3, 1, 2, ['user:'])) v(s, k, s2, made)),
        row_edits AS (SELECT conv_id, i, s, 'D' AS e, 3 AS c, s AS s2, [] AS made FROM f, range(4) q(s)
            UNION ALL SELECT conv_id, i, s, 'K', cut::INTEGER, CASE WHEN r = 's' THEN 1 WHEN r = 'u' THEN 2 ELSE 3 END, [role || ':' || text] FROM f, range(4) q(s)
                      WHERE NOT blank AND NOT again AND (r = 's' AND s = 0 OR r = 'u' AND s <> 2 OR r = 'a' AND s = 2)
            UNION ALL SELECT conv_id, i, s, 'R', 2 + cut::INTEGER, CASE WHEN s = 2 THEN 3 ELSE 2 END, [CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || text] FROM f, range(4) q(s) WHERE NOT blank AND NOT again),
        w AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS s, '000000000' AS v, []::VARCHAR[] AS made FROM t
            UNION ALL SELECT w.conv_id, w.i + 1, e.s2::BIGINT, min(lpad((left(w.v, 9)::BIGINT + 2 * ins.k + e.c)::VARCHAR, 9, '0') || substr(w.v, 10) || repeat('I', ins.k) || e.e),
                      arg_min(w.made || ins.made || e.made, lpad((left(w.v, 9)::BIGINT + 2 * ins.k + e.c)::VARCHAR, 9, '0') || substr(w.v, 10) || repeat('I', ins.k) || e.e)
                      FROM w JOIN ins ON ins.s = w.s JOIN row_edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.s = ins.s2 GROUP BY w.conv_id, w.i, e.s2),
        z AS (SELECT w.conv_id, min(lpad((left(w.v, 9)::BIGINT + 2 * ins.k)::VARCHAR, 9, '0') || substr(w.v, 10) || repeat('I', ins.k)) AS v,
                     arg_min(w.made || ins.made, lpad((left(w.v, 9)::BIGINT + 2 * ins.k)::VARCHAR, 9, '0') || substr(w.v, 10) || repeat('I', ins.k)) AS made
              FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i JOIN ins ON ins.s = w.s WHERE ins.s2 IN (0, 3) GROUP BY w.conv_id)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(left(v, 9)::BIGINT, 0) AS cost, coalesce(substr(v, 10), '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        e AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term FROM e GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY 1, 2, 3),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
        s AS (SELECT lang, source, sum(n) AS words FROM c GROUP BY 1, 2),
        l AS (SELECT lang, sum(words) AS words FROM s GROUP BY 1),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.words, 0) + v.v))::BIGINT AS p
              FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
        q AS (SELECT p.lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 1) // any_value(l.words + v.v))::BIGINT AS q FROM p JOIN v ON p.lang = v.lang JOIN l ON p.lang = l.lang GROUP BY 1, 2),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200""",
}
