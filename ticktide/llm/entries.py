"""The queries opN_ over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktide.llm import clustering, langid, sentencepiece_codec
from ticktide.llm.exact_dedup import exact_groups
from ticktide.llm.html_extract import extract
from ticktide.llm.mixing import placed, taken
from ticktide.llm.packing import pack
from ticktide.llm.quality import measured
from ticktide.llm.sharding import shard_documents
from ticktide.llm.simhash import near_duplicate_groups
from ticktide.llm.suffix_dedup import span_digests
from ticktide.llm.url_filter import judge
from ticktide.llm.whitening import whitened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The rules of the query, (host, path, allow).
URL_RULES = [
    ("com", "/en/", False), ("example.com", "/en/7", True), ("net", "/de/", True), ("example.net", "/de/8", False), ("org", "/es/", False),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, allow boolean")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return measured(docs).select("doc_id", *names)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its ids' number and checksum, and the size and checksum of the decoded text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.crc32(F.to_json("ids")).alias("ids_crc32"),
        F.octet_length("text").cast("long").alias("decoded_bytes"), F.crc32("text").alias("decoded_crc32"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    profiles = langid.learn(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.summarised(clustering.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return taken(placed(docs, weights=(5, 2, 1), budget=Fraction(3, 2), most=2))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pack": op2_pack,
    "op3_html_extract": op3_html_extract,
    "op4_shard": op4_shard,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_simhash": op8_simhash,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_langid": op10_langid,
    "op11_centroids": op11_centroids,
    "op12_mix": op12_mix,
    "op13_whitening": op13_whitening,
}



def centroids_sql(k: int, rounds: int, dims: int) -> str:
    """Rounds of a full search, one after the other."""
    parts = [f"""
        v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({clustering.SCALE} * x::DOUBLE)::BIGINT) AS e
            FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}
        ),
        x AS MATERIALIZED (SELECT r, unnest(range({dims})) AS d, unnest(e) AS x FROM v),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS c, e FROM v ORDER BY sha256('2:' || vec_id), e LIMIT {k}
        )"""]
    for i in range(rounds + 1):
        parts.append(f"""
        a{i} AS MATERIALIZED (
            SELECT r, min(c) AS c, min(distance) AS distance FROM (
                SELECT r, c, distance, min(distance) OVER (PARTITION BY r) AS low FROM (
                    SELECT r, c, list_sum(list_transform(list_zip(v.e, c{i}.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{i}
                )
            ) WHERE distance = low GROUP BY r
        )""")
        if i < rounds:
            parts.append(f"""
        c{i + 1} AS MATERIALIZED (
            SELECT c, list(m ORDER BY d) AS e FROM (
                SELECT c, d, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM a{i} JOIN x USING (r) GROUP BY c, d
            ) GROUP BY c
            UNION ALL SELECT c, e FROM c{i} WHERE c NOT IN (SELECT c FROM a{i})
        )""")
    return "WITH" + ",".join(parts) + f"""
        SELECT vec_id, a.c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c JOIN v USING (r)
    """


#: Targets in closed form: sources by rising limit over weight; those that stop are the first ones.
MIX_SQL = r"""
    WITH d AS (
        SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce('=' || source, '') AS k,
               md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS m
        FROM documents
    ),
    c AS (SELECT *, (row_number() OVER (PARTITION BY k, m, doc_id, size) - 1) // 1000 AS chunk FROM d),
    marked AS (SELECT doc_id, size, k, CASE WHEN chunk = 0 THEN m ELSE md5(m || ':' || chunk) END AS mark FROM c),
    weighed AS (
        SELECT k, sum(size)::BIGINT AS total, ([5, 2, 1])[((row_number() OVER (ORDER BY k = '', k) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY k
    ),
    rest AS (
        SELECT *, sum(w) OVER later AS wr, 3 * sum(total) OVER () - 4 * (sum(total) OVER later_all - total) AS tr FROM weighed
        WINDOW later AS (ORDER BY total::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
               later_all AS (ORDER BY total::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ),
    level AS (
        SELECT 3 * sum(total) - coalesce(sum(4 * total) FILTER (4 * total * wr <= w * tr), 0) AS t, sum(w) FILTER (4 * total * wr > w * tr) AS w FROM rest
    ),
    aimed AS (
        SELECT k, total, CASE WHEN 4 * total * wr <= rest.w * tr THEN (2 * total)::DOUBLE ELSE (rest.w * level.t)::DOUBLE / (2 * level.w)::DOUBLE END AS target FROM rest, level
    ),
    quota AS (SELECT *, least(floor(target + 0.5), 2 * total)::BIGINT AS quota, total // 1024 AS f FROM aimed),
    placed AS (
        SELECT row_number() OVER () AS r, doc_id, size, k, sum(size) OVER (PARTITION BY k ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS a FROM marked
    ),
    blocks AS (SELECT r, size, k, a, unnest(range(a // 1024, (a + size - 1) // 1024 + 1)) AS b FROM placed WHERE size > 0),
    drawn AS (
        SELECT r, size, a, b, e, total, greatest(0, least(total, quota - e * total)) AS words,
               CASE WHEN b < f THEN (b * (p % f)) % f ELSE f END AS pos
        FROM blocks JOIN quota USING (k), (VALUES (0, 2147483647), (1, 2147483629)) AS epochs(e, p)
    ),
    cut AS (SELECT r, greatest(0, least(a + size, b * 1024 + least(total - b * 1024, 1024, words - pos * 1024)) - greatest(a, b * 1024)) AS n FROM drawn),
    sums AS (SELECT r, sum(n)::BIGINT AS taken FROM cut GROUP BY r)
    SELECT doc_id, size, total AS source_size, target, coalesce(taken, 0)::BIGINT AS taken
    FROM placed JOIN quota USING (k) LEFT JOIN sums USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op12_mix": MIX_SQL,
    "op11_centroids": centroids_sql(40, 5, 64),
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d
    """,
    "op5_url_filter": r"""
        WITH rules(rh, rp, verdict) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ),
        rest AS (
            SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages
        ),
        parts AS (
            SELECT r, page_id, translate(regexp_extract(x, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        ),
        best AS (
            SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
            FROM parts, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)
    """,
    "op6_quality": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        windows AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
        repeated AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM windows) WHERE n > 1
        ),
        covered AS (
            SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY doc_id
        ),
        lines AS (SELECT doc_id, unnest(string_split(s, chr(10))) AS line FROM d),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                   length(regexp_replace(s, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
            FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)
        )
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
                    OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR (n_dup_lines >= 3 AND 25 * n_dup_lines > n_words)) AS kept
        FROM m
    """,
    "op4_shard": r"""
        WITH RECURSIVE
        crc_table AS (
            SELECT list(list_reduce(range(0, 9), lambda a, b: CASE WHEN b = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) ORDER BY n) AS t
            FROM range(0, 256) AS r(n)
        ),
        d AS (
            SELECT doc_id, coalesce(text, '') AS s, hex(encode(coalesce(text, ''))) AS h,
                   (coalesce(doc_id, 0)::HUGEINT + CASE WHEN coalesce(doc_id, 0) < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END)::UHUGEINT AS k0
            FROM documents
        ),
        sized AS (
            SELECT doc_id, k0, strlen(s) + 8 AS size,
                   xor(4294967295, list_reduce(
                       list_transform(range(0, strlen(s)), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
            FROM d, crc_table
        ),
        walk AS (
            SELECT DISTINCT k0, k0 AS k, 0::BIGINT AS j, 0::BIGINT AS s24, 0::BIGINT AS s25 FROM sized
            UNION ALL
            SELECT k0, nk, floor((j + 1) * (2147483648.0::DOUBLE / (nk // 8589934592::UHUGEINT + 1)::DOUBLE))::BIGINT,
                   CASE WHEN j < 24 THEN j ELSE s24 END, CASE WHEN j < 25 THEN j ELSE s25 END
            FROM (SELECT *, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS nk FROM walk WHERE j < 25)
        ),
        placed AS (SELECT k0, max(s24) AS s24, max(s25) AS s25 FROM walk GROUP BY k0)
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, s24::INT AS shard,
               row_number() OVER (
                   PARTITION BY s24
                   ORDER BY (((k0 + text_crc32::UHUGEINT) * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT // 1099511627776::UHUGEINT) % 64::UHUGEINT,
                            doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
               s25::INT AS grown_shard
        FROM sized JOIN placed USING (k0)
    """,
}
