"""The opN queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, divergence, lm_score, mixing, near_dedup, quality, secret_scan, substring_dedup, url_filter, warc, whitening

ROOT = str(Path(__file__).resolve().parents[2])

RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]
#: Hosts whose pages make up the list of canonical URLs.
LISTED_HOSTS = ["cheap-pills.example.com", "spam-farm.example.org"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers that Spark starts must find this package, whatever folder they start in
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{path}".rstrip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity=(80, 100))


def keep_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents are of quality and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return table(spark, sf_dir, "labels").select("doc_id", good.cast("int").alias("label"))


def op4_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), keep_labels(spark, sf_dir))


def op5_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"), k=10)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(url_filter.host_of(F.col("url")), r"^(www|m)\.", "")
    listed = pages.where(bare.isin(LISTED_HOSTS)).select(url_filter.canonical(F.col("url")).alias("url"))
    return url_filter.filter_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")



def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A conversation of control strings of the template, formatted with the others.
CONTROL = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(control)))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_minhash_near_dedup, op4_quality_cotraining, op5_warc_normalise, op6_ann_forest, op7_source_mix, op8_lm_score, op9_url_filter, op10_decontaminate, op11_chat_format, op12_embedding_whitening, op13_source_divergence)}

ORACLES = {
    "op5_warc_normalise": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS h FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
            CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f""",
    "op7_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) AS h, CAST(('0x' || substr(md5(coalesce(text, '')), 1, 12)) AS BIGINT) AS h1
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s),
        l AS (
            SELECT *, source_size * 1.0::DOUBLE / weight AS ratio,
                sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS left_words,
                sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight
            FROM r WINDOW o AS (ORDER BY source_size * 1.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, CAST(left_words AS DOUBLE) / CAST(left_weight AS DOUBLE) AS lvl FROM l),
        m AS (SELECT *, min(CASE WHEN lvl * weight <= 3 * source_size THEN {'a': ratio, 'b': lvl} END) OVER () AS best FROM c),
        t AS (SELECT source, source_size, least(coalesce(best.b * weight, CAST(3 * source_size AS DOUBLE)), CAST(3 * source_size AS DOUBLE)) AS target FROM m),
        w AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
        b AS (SELECT *, target - whole * source_size AS budget FROM w),
        u AS (
            SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.budget, d.size AS cell,
                sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.h1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
            FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target,
            CAST(size * (whole + CASE WHEN upto <= budget OR (upto - cell <= budget AND upto - budget < budget - (upto - cell)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM u""",
    "op9_url_filter": r"""
        WITH p AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        c AS (
            SELECT *, regexp_replace(host, '^(www|m)\.', '') AS bare, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '') AS canon,
                CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM p),
        l AS (SELECT DISTINCT canon FROM c WHERE bare IN ('cheap-pills.example.com', 'spam-farm.example.org'))
        SELECT page_id, host, path, rule,
            CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END AS verdict
        FROM c""",
    "op11_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
        e AS (
            SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|)', '\1\\\2\3', 'g'))
                + CASE role WHEN 'user' THEN length('[INST] ' || ' [/INST]') WHEN 'assistant' THEN length(' ' || '</s>')
                    WHEN 'system' THEN length('<<SYS>>' || '<</SYS>>') + 3
                    ELSE length('<||>' || '<|end|>') + 3 + length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '|', '\p')) END AS size
            FROM c),
        g AS (
            SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss, 3 + sum(size) AS chars
            FROM e GROUP BY conv_id)
        SELECT conv_id, n AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g""",
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        o AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        n AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
        s AS (SELECT g.lang, g.source, coalesce(sum(n.c), 0) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY g.lang, g.source),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 5)) // (s.total + 5 * v.v) AS BIGINT) AS p
            FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang JOIN s ON s.lang = g.lang AND s.source = g.source
            LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
        l AS (SELECT lang, sum(total) AS total FROM s GROUP BY lang),
        q AS (
            SELECT k.lang, k.term, CAST(1 + (1000000000::HUGEINT * (sum(n.c) + 5)) // (any_value(l.total) + 5 * any_value(v.v)) AS BIGINT) AS q
            FROM k JOIN n USING (lang, term) JOIN l ON l.lang = k.lang JOIN v ON v.lang = k.lang GROUP BY k.lang, k.term),
        far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(far.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
            UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q),
        f AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
        SELECT lang, source, part, item, value, rank FROM f WHERE part = 'pair' OR rank <= 50""",
}
