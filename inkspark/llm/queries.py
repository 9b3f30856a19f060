"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, language, licences, mixing, phrases, quality, rp_forest, sharding, simhash, spelling, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: The mixture of op2: entropy of at least 95 % of that of equal weights, as many tokens as the corpus has.
MIX = {"target_entropy": 0.95, "budget": 1.0}


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), **MIX)
    return mixed.select("doc_id", "source", "n_tokens", "epoch", "block", F.floor(F.col("weight") * 1e9 + 0.5).cast("long").alias("weight_ppb"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.write_and_read(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), 40)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.95)


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.fit(docs))
    sure = F.filter("findings", lambda f: f.confirmed)
    best = F.get(F.array_sort(sure, lambda a, b: F.when(a.probability > b.probability, -1).when(a.probability < b.probability, 1).otherwise(a.paragraph - b.paragraph)), F.lit(0))
    return found.select(
        "doc_id", "n_paragraphs", F.size("findings").cast("long").alias("n_found"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f.family))), ",").alias("families"),
        best.probability.alias("probability"), best.similarity.alias("similarity"),
    )


#: Rank file and pattern of op9 and of the pipeline's last stage.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")), 0.7)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants_of_words(_table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mix_sources, op3_token_counts, op4_warc, op5_shard, op6_simhash, op7_embedding_dedup, op8_licence_scan, op9_byte_bpe, op10_quality, op11_collocations, op12_spelling_variants, op13_language_id)}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op2_mix_sources": r"""
        WITH RECURSIVE costs AS MATERIALIZED (
            SELECT doc_id, source, coalesce('=' || source, '-') AS skey, substr(md5('7|' || doc_id), 1, 3) AS block,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n_tokens FROM documents),
        blocks AS MATERIALIZED (SELECT skey, block, sum(n_tokens)::BIGINT AS tokens FROM costs GROUP BY 1, 2),
        sources AS MATERIALIZED (SELECT skey, sum(tokens)::BIGINT AS tokens FROM blocks GROUP BY 1),
        shares AS MATERIALIZED (SELECT skey, tokens, tokens::DOUBLE / (SELECT sum(tokens)::DOUBLE FROM sources) AS p FROM sources),
        bisect(lo, hi) AS (
            SELECT 0::BIGINT, 1048577::BIGINT
            UNION ALL
            SELECT CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END FROM (
                SELECT b.lo, b.hi, (b.lo + b.hi) // 2 AS mid,
                       ln(sum(pow(p, ((b.lo + b.hi) // 2) / 1048576.0::DOUBLE)))
                       - sum(pow(p, ((b.lo + b.hi) // 2) / 1048576.0::DOUBLE) * ln(p) * (((b.lo + b.hi) // 2) / 1048576.0::DOUBLE))
                         / sum(pow(p, ((b.lo + b.hi) // 2) / 1048576.0::DOUBLE)) >= 0.95::DOUBLE * ln(count(*)) - 1e-12 AS good
                FROM bisect b, shares WHERE b.hi - b.lo > 1 GROUP BY b.lo, b.hi)),
        alpha AS (SELECT max(lo) / 1048576.0::DOUBLE AS a FROM bisect),
        powered AS MATERIALIZED (SELECT skey, tokens, pow(p, (SELECT a FROM alpha)) AS q FROM shares),
        plan0 AS (SELECT skey, tokens, q / (SELECT sum(q) FROM powered) AS weight,
                         q / (SELECT sum(q) FROM powered) * (SELECT sum(tokens)::DOUBLE FROM sources) AS quota FROM powered),
        plan1 AS (SELECT *, floor(quota / tokens + 1e-9)::BIGINT AS epochs FROM plan0),
        plan AS MATERIALIZED (SELECT *, floor(greatest(0.0, quota - epochs * tokens + 1e-6))::BIGINT AS rest FROM plan1),
        ordered AS (SELECT b.skey, block, b.tokens, rest, epochs, md5('7|' || b.skey || '|' || epochs || '|' || block) AS place
                    FROM blocks b JOIN plan USING (skey)),
        run AS (SELECT *, sum(tokens) OVER (PARTITION BY skey ORDER BY place) AS upto FROM ordered),
        edge AS MATERIALIZED (SELECT skey, min(place) AS cut_block, arg_min(block, place) AS edge_block, arg_min(upto - tokens, place) AS before
                 FROM run WHERE rest > 0 AND upto >= rest GROUP BY skey),
        inside AS (SELECT c.skey, md5('7|' || epochs || '|' || doc_id) AS place, n_tokens, before, rest
                   FROM costs c JOIN edge e ON c.skey = e.skey AND c.block = e.edge_block JOIN plan ON plan.skey = c.skey),
        fits AS (SELECT *, before + sum(n_tokens) OVER (PARTITION BY skey ORDER BY place) AS upto FROM inside),
        cut AS (SELECT skey, max(place) AS cut_doc FROM fits WHERE upto <= rest GROUP BY skey),
        copies AS (SELECT c.*, weight, epochs + CASE WHEN
                     md5('7|' || c.skey || '|' || epochs || '|' || block) < cut_block
                     OR (md5('7|' || c.skey || '|' || epochs || '|' || block) = cut_block AND md5('7|' || epochs || '|' || doc_id) <= cut_doc)
                     THEN 1 ELSE 0 END AS n
                   FROM costs c JOIN plan USING (skey) LEFT JOIN edge USING (skey) LEFT JOIN cut USING (skey))
        SELECT doc_id, source, n_tokens, unnest(range(n)) AS epoch, block, floor(weight * 1e9 + 0.5)::BIGINT AS weight_ppb FROM copies""",
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        phrases AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM starts, range(1, 6) AS s(k) WHERE i + k - 1 <= len(w)),
        counts AS MATERIALIZED (SELECT lang, phrase, k, count(*)::BIGINT AS a FROM phrases GROUP BY lang, phrase, k HAVING count(*) >= 100),
        split AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2),
        inner_ones AS (
            SELECT DISTINCT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
            FROM split, range(2, 5) AS s(m), range(1, 5) AS t(i) WHERE m < k AND i + m - 1 <= k),
        kept AS (SELECT * FROM split ANTI JOIN inner_ones USING (lang, phrase, a)),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, f.a AS l, r.a AS r, n, j, (1000::HUGEINT * c.a * n // (f.a::HUGEINT * r.a))::BIGINT AS score
            FROM kept c, range(1, 5) AS s(j), counts f, counts r, totals t
            WHERE j < c.k AND f.lang = c.lang AND r.lang = c.lang AND t.lang = c.lang
              AND f.phrase = array_to_string(c.w[1:j], ' ') AND r.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
}
