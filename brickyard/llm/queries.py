"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, hnsw, jaccard, licenses, merkle, pii, quality, substring, toxicity, urlfilter, warc
from .common import fold, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path(RANKS)
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's quality by a Bradley-Terry ranking."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold("doc_id", 5) != 0)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's toxicity by positive-unlabelled learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold("doc_id", 4) != 2)
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search every document for windows of the benchmark's items."""
    return decontaminate.digest(decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return pii.digest(docs.select("doc_id", pii.spans(F.col("text")).alias("spans")))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label."""
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives and read them back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("group_id", "text_hash")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds too."""
    return substring.near_passages(table(spark, sf_dir, "documents"))


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture against dated lists of hosts, domains and folders derived from the pages.

    The tables hold no lists, so a rule over each host's first page makes them: a third of the
    hosts are listed and taken off again, some domains and folders too.
    """
    pages = table(spark, sf_dir, "pages")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def at(minutes):
        return F.timestamp_seconds(F.unix_seconds(start) + 60 * minutes)

    captures = pages.select(F.col("page_id").alias("capture_id"), "url", at(F.pmod(F.col("page_id") * 37, F.lit(43_200))).alias("fetched"))
    hosts = pages.select("page_id", urlfilter.host(F.col("url")).alias("host")).where("host is not null").groupBy("host").agg(F.min("page_id").alias("f"))
    domains = hosts.select(F.substring_index("host", ".", -2).alias("host"), "f").groupBy("host").agg(F.min("f").alias("f"))
    day = 1_440

    def events(rows: DataFrame, kind: str, key, category: str, action: str, minutes) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), key.alias("key"), F.lit(category).alias("category"), F.lit(action).alias("action"), at(minutes).alias("ts"))

    f, h = F.col("f"), F.col("host")
    listed, left, back = hosts.where("f % 3 = 0"), hosts.where("f % 6 = 0"), hosts.where("f % 12 = 0")
    spam, folder = domains.where("f % 4 = 1"), hosts.where("f % 5 = 1")
    found = (
        events(listed, "host", h, "ads", "add", F.pmod(f * 11, F.lit(20_000)))
        .union(events(left, "host", h, "ads", "remove", F.pmod(f * 11, F.lit(20_000)) + 5 * day))
        .union(events(back, "host", h, "ads", "add", F.pmod(f * 11, F.lit(20_000)) + 9 * day))
        .union(events(spam, "domain", h, "spam", "add", F.lit(5 * day)))
        .union(events(spam, "domain", h, "spam", "remove", F.lit(20 * day)))
        .union(events(folder, "prefix", F.concat(h, F.lit("/en/")), "english", "add", F.lit(3 * day)))
    )
    return urlfilter.evaluate(captures, found).select(
        "capture_id", "host", "blocked", F.size("categories").cast("long").alias("n_categories"), F.array_join("categories", ",").alias("categories")
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every source's words differ from the other sources' and from the language's."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle tree over all documents, and the check of documents whose line ends were partly deleted."""
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.without_newlines(docs))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents name or quote."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_jaccard, op3_near_vectors, op4_substring, op5_quality, op6_toxicity, op7_urlfilter, op8_decontaminate, op9_warc, op10_pii,
        op11_divergence, op12_merkle, op13_licenses,
    )
}

#: The remainders of crc32, by its rule.
_CRC = ", ".join(str(reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(8), k)) for k in range(256))

_REACH = """
, reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
, low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
"""

ORACLES = {
    "op2_jaccard": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_have AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM both_have JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
){_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON low.x = d.doc_id
""",
    "op3_near_vectors": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93
){_REACH}
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(low.y, e.vec_id)) AS component_id, e.vec_id <= coalesce(low.y, e.vec_id) AS kept
FROM embeddings e LEFT JOIN low ON low.x = e.vec_id LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) c ON c.x = e.vec_id
""",
    "op7_urlfilter": """
WITH h AS (
  SELECT page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\\.$', ''), '') AS host,
    coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path, (page_id * 37) % 43200 AS t
  FROM pages
), hosts AS (SELECT host, min(page_id) AS f FROM h WHERE host IS NOT NULL GROUP BY host),
domains AS (SELECT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS host, min(f) AS f FROM hosts GROUP BY 1),
hits AS (
  SELECT page_id, 'ads' AS category FROM h JOIN hosts USING (host)
  WHERE f % 3 = 0 AND t >= (f * 11) % 20000 AND (f % 6 <> 0 OR t < (f * 11) % 20000 + 7200 OR f % 12 = 0 AND t >= (f * 11) % 20000 + 12960)
  UNION ALL
  SELECT page_id, 'spam' FROM h JOIN domains d ON h.host = d.host OR ends_with(h.host, '.' || d.host) WHERE f % 4 = 1 AND t >= 7200 AND t < 28800
  UNION ALL
  SELECT page_id, 'english' FROM h JOIN hosts USING (host) WHERE f % 5 = 1 AND t >= 4320 AND starts_with(lower(path), '/en/')
), found AS (SELECT page_id, list_sort(list(DISTINCT category)) AS c FROM hits GROUP BY page_id)
SELECT page_id AS capture_id, host, c IS NOT NULL AS blocked, coalesce(len(c), 0) AS n_categories, coalesce(array_to_string(c, ','), '') AS categories
FROM h LEFT JOIN found USING (page_id)
""",
    "op8_decontaminate": """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM windows),
runs AS (
  SELECT doc_id, k, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM docs, lengths WHERE len(w) >= m)
), found AS (SELECT doc_id, k, runs.m, item_id FROM runs JOIN windows ON runs.s = windows.s AND runs.m = windows.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS c FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(c), 0) AS n_items,
  sha256(coalesce(array_to_string(c, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
FROM q
""",
    "op11_divergence": """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), seen AS (SELECT d, lang, source, unnest(w) AS t FROM docs),
kept AS (SELECT lang, t FROM seen GROUP BY lang, t HAVING count(DISTINCT d) >= 10),
counts AS (SELECT lang, source, t, count(*) AS c FROM seen SEMI JOIN kept USING (lang, t) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grid AS (
  SELECT g.lang, g.source, k.t, coalesce(c, 0) AS c FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, t)
), shares AS (
  SELECT lang, source, t, c, 1 + 1000000000 * (c + 2)::HUGEINT // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM grid JOIN sizes USING (lang)
), whole AS (
  SELECT lang, t, 1 + 1000000000 * (c + 2)::HUGEINT // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, t, sum(c) AS c FROM counts GROUP BY lang, t) JOIN sizes USING (lang)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM kept)
  UNION ALL
  SELECT lang, source, 'term', t, (p - q) * (p - q) // (p + q) FROM shares JOIN whole USING (lang, t) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
""",
    "op12_merkle": f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head, text,
    list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, [{_CRC}][1 + (xor(c, b) & 255)])) & 1 AS odd
  FROM documents
), texts AS (SELECT *, CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END AS now FROM fields),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(now)) || ':' || now, '-')) AS altered FROM texts
), placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
low AS (
  SELECT source, 0 AS l, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY source, l, i // 3
), tops AS (SELECT source, l, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS l, i, h, n FROM tops
  UNION ALL
  SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY l, i // 3
), climb AS (
  SELECT row_number() OVER () AS id, p.doc_id, p.source, p.leaf, p.altered, p.i, t.i AS top, t.h AS subroot, t.l AS height FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source
), runs AS (
  SELECT source, l, i // 3 AS r, list(struct_pack(i := i, h := h) ORDER BY i) AS m FROM low WHERE n > 1 GROUP BY source, l, i // 3
), tall AS (SELECT l, i // 3 AS r, list(struct_pack(i := i, h := h) ORDER BY i) AS m FROM high WHERE n > 1 GROUP BY l, i // 3),
up AS (
  SELECT id, source, top, height, 0 AS l, i, altered AS h, '' AS proof FROM climb
  UNION ALL
  SELECT id, source, top, height, l + 1, CASE WHEN l + 1 = height THEN top ELSE i // 3 END, sha256(list_aggregate(list_transform(m, lambda x: CASE WHEN x.i = i THEN h ELSE x.h END), 'string_agg', '')),
    proof || coalesce(list_aggregate(list_transform(list_filter(m, lambda x: x.i <> i), lambda x: x.h), 'string_agg', ''), '')
  FROM (
    SELECT up.*, coalesce(runs.m, tall.m) AS m FROM up LEFT JOIN runs ON up.l < height AND runs.source IS NOT DISTINCT FROM up.source AND runs.l = up.l AND runs.r = up.i // 3
    LEFT JOIN tall ON up.l >= height AND tall.l = up.l - height AND tall.r = (CASE WHEN up.l = height THEN top ELSE up.i END) // 3
  ) WHERE m IS NOT NULL
), ends AS (SELECT id, h, proof FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l DESC) AS k FROM up) WHERE k = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, ends.h AS folded_root, ends.h = root AS verified
FROM climb JOIN ends USING (id), (SELECT h AS root FROM high WHERE n = 1)
""",
}
