"""Registered queries of the training-data operators: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, packing, pieces, prefix_trie, quality, repeats, secrets, simhash, token_files, toxicity, url_filter, whitening, wrapper
from .common import scratch, tables

# The rules and the listed hosts of op6.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
LISTED_HOSTS = ["spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.org", "ads-track.example.org", "free-bets.example.com"]


TOXICITY_CHAIN = ["low_quality", "toxic", "toxic_low_quality"]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(tables(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, tables(spark, sf_dir, "benchmark"), least=5, threshold=0.6)
    contaminated = F.size("hits") > 0
    return found.select(
        "doc_id",
        contaminated.alias("contaminated"),
        (~contaminated).alias("kept"),
        F.coalesce(F.array_max("hits.coverage"), F.lit(0.0)).alias("coverage"),
        F.sort_array("hits.item_id").alias("item_ids"),
    )


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's categories: poor text, toxic text, and both at once."""
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return tables(spark, sf_dir, "labels").select(
        "doc_id", poor.cast("int").alias("low_quality"), toxic.cast("int").alias("toxic"), (poor & toxic).cast("int").alias("toxic_low_quality")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, toxicity_labels(spark, sf_dir), TOXICITY_CHAIN, balance="toxic", sample_rows=6000)
    judged = toxicity.predict(docs, chain)
    toxic = F.col("is_toxic")
    return judged.select("doc_id", toxic.alias("toxic"), (~toxic).alias("kept"), *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in TOXICITY_CHAIN])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return token_files.token_files(spark, docs, scratch(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(tables(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [*URL_RULES.items(), *((host, "listed") for host in LISTED_HOSTS)]
    uris, lengths = url_filter.build(spark.createDataFrame(entries, "entry string, says string"), scratch(spark, "digests"))
    return url_filter.judge(tables(spark, sf_dir, "pages"), uris, lengths)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(tables(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(tables(spark, sf_dir, "documents"), max_distance=2, segments=2, words=3)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(tables(spark, sf_dir, "documents"), window=13, gram=5)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placed(packing.packed(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(tables(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.prefix_trie(prefix_trie.with_shared_beginnings(prefix_trie.sequences(turns)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(tables(spark, sf_dir, "embeddings"), leading=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_decontaminate, op3_toxicity, op4_token_files, op5_secrets, op6_url_filter, op7_main_text, op8_simhash, op9_repeats, op10_packing, op11_pieces, op12_prefix_trie, op13_whitening)}


OP6_SQL = """
WITH rules(rule, host, path, says) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
  ('org/es/', 'org', '/es/', 'block')),
listed(host) AS (VALUES ('spam-farm.example.org'), ('cheap-pills.example.com'), ('casino-win.example.org'),
  ('ads-track.example.org'), ('free-bets.example.com')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parsed AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM named),
fits AS (SELECT p.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.says, length(r.rule)) AS says
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1),
spam AS (SELECT DISTINCT p.page_id FROM parsed p JOIN listed l ON p.host = l.host OR ends_with(p.host, '.' || l.host))
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.says, CASE WHEN s.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parsed p LEFT JOIN fits f USING (page_id) LEFT JOIN spam s USING (page_id)
"""

OP9_SQL = r"""
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM split),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM placed),
low AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (s) WHERE doc_id > least),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM split),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN counted USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

# CRC-32 is computed bit by bit: a byte is mixed in, then eight steps (-1) follow.
OP12_SQL = r"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END) END), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (SELECT c.conv_id, t.i, t.role, t.text, 0 AS own FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i <= c.h
  UNION ALL SELECT c.conv_id, t.i, t.role, t.text, 1 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
placed AS (SELECT conv_id, text, row_number() OVER w AS d, list(sha256(length(role) || ':' || role || text)) OVER w AS prefix FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
path AS (SELECT conv_id, d, text, prefix FROM placed UNION ALL SELECT conv_id, 0, '', CAST([] AS VARCHAR[]) FROM convs),
ended AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS last FROM path),
node AS (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n, min(text) AS text,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM ended GROUP BY prefix, d),
linked AS (SELECT a.*, b.conv_id AS parent FROM node a LEFT JOIN node b ON a.d = b.d + 1 AND a.prefix[:a.d - 1] = b.prefix),
own AS (SELECT *, (n - 1) * len(regexp_extract_all(text, '[^ 	-
]+')) AS saved,
  (SELECT count(*) FROM linked k WHERE k.parent = l.conv_id AND k.d = l.d + 1) AS children FROM linked l),
below AS (SELECT m.conv_id AS top, m.d AS deep, own.* FROM own JOIN path p ON p.conv_id = own.conv_id AND p.d <= own.d JOIN node m ON m.d = p.d AND m.prefix = p.prefix),
sums AS (SELECT top, deep, sum(saved) AS saved, count(*) FILTER (children = 0) AS leaves FROM below GROUP BY ALL)
SELECT CAST(o.conv_id AS BIGINT) AS conv_id, CAST(o.d AS BIGINT) AS depth, CAST(o.parent AS BIGINT) AS parent_conv_id, CAST(o.n AS BIGINT) AS n_convs, CAST(o.children AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN sums s ON s.top = o.conv_id AND s.deep = o.d
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op9_repeats": OP9_SQL, "op12_prefix_trie": OP12_SQL}
