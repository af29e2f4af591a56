"""The registered queries of this package: thin calls that give each operator its production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.llm import (
    bpe, filter_audit, line_dedup, mixing, near_duplicates, packing, personal_data, quality, resampling, sharding,
    token_counts, url_filter, vector_search,
)
from footmark.llm.common import table

RANK_FILE, WORD_FILE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
SHARDS = sharding.ShardTable(tuple(f"shard-{i:02d}" for i in range(16)))
TARGETS = mixing.Mix(weights=(
    {"web": 40, "news": 20, "books": 25, "forum": 15}, {"en": 50, "de": 20, "fr": 20, "es": 10}, {}))


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest products of every fiftieth vector against all others."""
    return vector_search.top_k(table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal data of every document."""
    found = personal_data.find(table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("base", lambda x: x["kind"] == n)).cast("long")
    spans = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id", *[count(n).alias(f"n_{kind}") for n, kind in enumerate(personal_data.KINDS)],
        F.sha2(personal_data.listed(F.col("base")), 256).alias("base_sha256"), personal_data.listed(spans).alias("spans"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN,
                      ("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated line chunks and passages, and the number of lines cut."""
    return line_dedup.remove_all(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated passages of any place and length, and the number of lines cut."""
    return line_dedup.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base verdict and final verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE),
                                     public_tokenizers.PATTERN)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def source_levels() -> dict[str, object]:
    """Domain (by the number in the source's name, five sources each), language and source."""
    number = F.try_to_number(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,6})$", 1), F.lit("999999"))
    domains = F.array(*[F.lit(x) for x in ("web", "news", "books", "forum")])
    domain = F.get(domains, F.coalesce((number.cast("int") / 5).cast("int"), F.lit(3)))
    return {"domain": F.coalesce(domain, F.lit("forum")), "lang": F.col("lang"), "source": F.col("source")}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mixture by target weights, once for each epoch that takes them."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs, source_levels(), TARGETS).select("doc_id", "lang", "source", "epoch")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document's tokens, and its place in a sequence of at most 2,048."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE), outputs=("ids_crc32",))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source at each step of each of their 120 orders."""
    masks = filter_audit.masks(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.mask_counts(masks, table(spark, sf_dir, "labels")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, its score and its rank among the tenth drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id,
             CAST(list_sum([CAST(q.e[i] * v.e[i] AS BIGINT) FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP2_SQL = r"""
WITH rules(rule, host_part, path_part, action) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT *, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*((?s:.*))', 1), '') AS rest FROM u),
w AS (SELECT *, CASE WHEN contains(url, '://') THEN host || rest ELSE url END AS whole FROM p),
f AS (SELECT w.*, (SELECT {'r': rule, 'a': action} FROM rules
        WHERE (host = host_part OR ends_with(host, '.' || host_part)) AND starts_with(path, path_part)
        ORDER BY length(rule) DESC, rule LIMIT 1) AS top,
        regexp_matches(whole, '^(?:[^/?#]*\.)?(?:ads|tracker)\.(?s:.*)(?:[^A-Za-z0-9_.%-]|$)')
          OR regexp_matches(whole, '/banner/(?s:.*)/img(?:[^A-Za-z0-9_.%-]|$)')
          OR regexp_matches(whole, '[^A-Za-z0-9_.%-]sessionid=')
          OR regexp_matches(whole, '[^A-Za-z0-9_.%-]utm_source=feed(?:[^A-Za-z0-9_.%-]|$)')
          OR contains(whole, '/cgi-bin/') OR ends_with(whole, '.exe') AS blocked,
        ends_with(whole, '/robots.txt') AS allowed FROM w)
SELECT page_id, host, path, top.r AS rule,
       CASE WHEN top IS NOT NULL THEN top.a WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END AS verdict FROM f
"""

OP3_SQL = """
WITH RECURSIVE shards AS (
  SELECT i, CAST('0x' || substr(md5('offset:shard-' || lpad(CAST(i AS VARCHAR), 2, '0')), 1, 15) AS BIGINT) % 2039 AS first,
         CAST('0x' || substr(md5('step:shard-' || lpad(CAST(i AS VARCHAR), 2, '0')), 1, 15) AS BIGINT) % 2038 + 1 AS step
  FROM range(16) t(i)),
prefs AS (SELECT list([(first + j * step) % 2039 FOR j IN range(2039)] ORDER BY i) AS p FROM shards),
filled AS (
  SELECT 0 AS turn, [CAST(-1 AS INTEGER) FOR x IN range(2039)] AS t
  UNION ALL
  SELECT turn + 1, (SELECT [CASE WHEN k - 1 = want THEN CAST(turn % 16 AS INTEGER) ELSE t[k] END FOR k IN range(1, 2040)]
                    FROM (SELECT list_filter(p[turn % 16 + 1], lambda s: t[s + 1] < 0)[1] AS want FROM prefs))
  FROM filled WHERE turn < 2039),
lookup AS (SELECT unnest(range(2039)) AS slot, unnest(t) AS i FROM filled WHERE turn = 2039)
SELECT d.doc_id, l.slot, 'shard-' || lpad(CAST(l.i AS VARCHAR), 2, '0') AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % 2039 AS slot
      FROM documents) d JOIN lookup l ON d.slot = l.slot
"""

OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
h AS (SELECT *, [CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) FOR x IN l] AS h FROM d),
b AS (SELECT *, [i FOR i IN range(len(l)) IF i = len(l) - 1 OR (coalesce(h[i], 0) * 31 + h[i + 1]) % 2 = 0] AS e FROM h),
c AS (SELECT n, doc_id, md5(text) AS k, l, unnest(range(1, len(e) + 1)) AS j, e FROM b WHERE text IS NOT NULL),
s AS (SELECT n, doc_id, k, CASE WHEN j = 1 THEN 0 ELSE e[j - 1] + 1 END AS a, e[j] AS z, l FROM c),
m AS (SELECT n, doc_id, k, a, z, array_to_string(l[a + 1:z + 1], chr(10)) AS chunk FROM s WHERE z > a),
r AS (SELECT *, dense_rank() OVER (PARTITION BY chunk ORDER BY doc_id NULLS LAST, k, a) AS rank FROM m
      WHERE regexp_matches(chunk, '[^\x20\x09-\x0D]')),
g AS (SELECT n, list({'a': a, 'z': z}) AS gone, sum(z - a + 1) AS cut FROM r WHERE rank > 1 GROUP BY n),
o AS (SELECT d.n, doc_id, coalesce(cut, 0) AS cut, CASE WHEN g.n IS NULL THEN text ELSE coalesce(array_to_string(
         [l[i + 1] FOR i IN range(len(l)) IF len([x FOR x IN gone IF i >= x.a AND i <= x.z]) = 0], chr(10)), '') END AS text
  FROM d LEFT JOIN g ON d.n = g.n),
u AS (SELECT *, md5(text) AS k, string_split(text, chr(10)) AS l FROM o),
v AS (SELECT n, doc_id, k, l, unnest(range(len(l))) AS i FROM u),
y AS (SELECT *, len(regexp_extract_all(l[i + 1], '[^\x20\x09-\x0D]+')) AS w,
        len(regexp_extract_all(l[i + 2], '[^\x20\x09-\x0D]+')) AS w1 FROM v),
t AS (SELECT n, doc_id, k, i, i AS z, l[i + 1] AS piece FROM y WHERE w >= 8
      UNION ALL SELECT n, doc_id, k, i, i + 1, l[i + 1] || chr(10) || l[i + 2] FROM y WHERE i + 1 < len(l) AND w + w1 > 0),
f AS (SELECT *, dense_rank() OVER (PARTITION BY piece ORDER BY doc_id NULLS LAST, k, i, z) AS rank FROM t),
x AS (SELECT n, list_distinct(list(i)) AS gone FROM (SELECT n, unnest(range(i, z + 1)) AS i FROM f WHERE rank > 1) GROUP BY n)
SELECT doc_id, CASE WHEN x.n IS NULL THEN text ELSE coalesce(array_to_string(
         [l[i + 1] FOR i IN range(len(l)) IF NOT list_contains(gone, i)], chr(10)), '') END AS text,
       CAST(cut + coalesce(len(gone), 0) AS BIGINT) AS n_removed_lines
FROM u LEFT JOIN x ON u.n = x.n
"""

OP9_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingled a JOIN shingled b
           ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id
          WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(y, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least ON d.doc_id = x
"""


def _share_sql(name: str, children: str, parent: str) -> str:
    """CTEs that split each parent's budget among its children (a family is ``fam``, a child ``kid``)."""
    return f"""
{name}_m AS (SELECT c.*, p.budget AS given,
    CASE WHEN c.weight > 0 AND c.capacity > 0 THEN c.weight ELSE 0 END AS w,
    CASE WHEN c.weight > 0 AND c.capacity > 0 THEN c.capacity ELSE 0 END AS c
    FROM {children} c JOIN {parent} p ON c.fam = p.id),
{name}_o AS (SELECT *, coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_onward FROM {name}_m
    WINDOW o AS (PARTITION BY fam ORDER BY CASE WHEN w > 0 THEN 0 ELSE 1 END, CAST(capacity AS DOUBLE) / greatest(weight, 1), kid)),
{name}_f AS (SELECT *, w > 0 AND CAST(c AS HUGEINT) * w_onward <= CAST(w AS HUGEINT) * (given - c_before) AS is_full FROM {name}_o),
{name}_l AS (SELECT *, given - sum(CASE WHEN is_full THEN c ELSE 0 END) OVER (PARTITION BY fam) AS rest,
    sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY fam) AS w_open FROM {name}_f),
{name} AS (SELECT id, tokens, CAST(CASE WHEN is_full THEN c WHEN w > 0
    THEN least(c, CAST(w AS HUGEINT) * rest // greatest(w_open, 1)) ELSE 0 END AS BIGINT) AS budget FROM {name}_l)"""


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS lang_, coalesce(source, '') AS source_,
         CASE coalesce(CAST(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,6})$', 1), '') AS INTEGER) // 5 AS INTEGER), 3)
           WHEN 0 THEN 'web' WHEN 1 THEN 'news' WHEN 2 THEN 'books' ELSE 'forum' END AS domain_,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain_, lang_, source_, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS capacity FROM d GROUP BY ALL),
root AS (SELECT 'root' AS id, CAST(coalesce(sum(tokens), 0) * 80 // 100 AS BIGINT) AS budget FROM leaves),
k1 AS (SELECT 'root' AS fam, domain_ AS kid, domain_ AS id, sum(capacity)::BIGINT AS capacity, sum(tokens)::BIGINT AS tokens,
         CASE domain_ WHEN 'web' THEN 40 WHEN 'news' THEN 20 WHEN 'books' THEN 25 WHEN 'forum' THEN 15 ELSE 1 END AS weight
       FROM leaves GROUP BY domain_),
k2 AS (SELECT domain_ AS fam, lang_ AS kid, domain_ || '|' || lang_ AS id, sum(capacity)::BIGINT AS capacity, sum(tokens)::BIGINT AS tokens,
         CASE lang_ WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 1 END AS weight
       FROM leaves GROUP BY domain_, lang_),
k3 AS (SELECT domain_ || '|' || lang_ AS fam, source_ AS kid, domain_ || '|' || lang_ || '|' || source_ AS id, capacity, tokens,
         1 AS weight FROM leaves),""" + _share_sql("b1", "k1", "root") + "," + _share_sql("b2", "k2", "b1") + "," + \
    _share_sql("b3", "k3", "b2") + r""",
e AS (SELECT d.*, CASE WHEN b3.tokens > 0 THEN b3.budget // b3.tokens ELSE 0 END AS whole,
        CASE WHEN b3.tokens > 0 THEN b3.budget % b3.tokens ELSE 0 END AS rest,
        CAST('0x' || substr(md5('7:' || CAST(CASE WHEN b3.tokens > 0 THEN b3.budget // b3.tokens ELSE 0 END AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS draw,
        b3.id FROM d JOIN b3 ON domain_ || '|' || lang_ || '|' || source_ = b3.id),
t AS (SELECT *, sum(tokens) OVER (PARTITION BY id ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM e)
SELECT doc_id, lang, source, unnest(range(0, least(2, whole + CASE WHEN total <= rest THEN 1 ELSE 0 END))) AS epoch FROM t
"""

OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
             min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, instr(filter_order, x) AS step, bit AS own, coalesce((SELECT sum(y.bit) FROM x y
        WHERE instr(filter_order, y.x) < instr(filter_order, x.x)), 0)::INTEGER AS before FROM o, x),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT n, w, count(*) AS c FROM (SELECT n, unnest(w) AS w FROM d) GROUP BY n, w),
g AS (SELECT w, count(*) AS c FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
        FROM (SELECT unnest(range(256)) AS i)),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(hex(encode(w)), 2 * j + 1, 2) AS BIGINT)
          FOR j IN range(octet_length(encode(w)))]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b
      FROM (SELECT w FROM f UNION SELECT w FROM g), crc),
s AS (SELECT b, sum(c) AS s FROM f JOIN k USING (w) GROUP BY b), t AS (SELECT b, sum(c) AS t FROM g JOIN k USING (w) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
           / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
         FROM s FULL JOIN t USING (b)),
v AS (SELECT n, sum(c * gain) AS weight FROM f JOIN k USING (w) JOIN gain USING (b) GROUP BY n),
z AS (SELECT n, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN v USING (n)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r,
        count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS draws FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN r <= draws THEN r END AS BIGINT) AS rank FROM r
"""

QUERIES = {f.__name__: f for f in (
    op1_vector_search, op2_url_filter, op3_sharding, op4_personal_data, op5_bpe, op6_line_dedup, op6_passage_dedup, op7_quality,
    op8_token_counts, op9_near_duplicates, op10_mixing, op11_packing, op12_filter_audit, op13_resampling)}
ORACLES = {"op1_vector_search": OP1_SQL, "op2_url_filter": OP2_SQL, "op3_sharding": OP3_SQL, "op6_line_dedup": OP6_SQL,
           "op9_near_duplicates": OP9_SQL, "op10_mixing": OP10_SQL, "op12_filter_audit": OP12_SQL, "op13_resampling": OP13_SQL}
