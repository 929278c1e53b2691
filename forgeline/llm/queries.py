"""The queries over whole tables, opN_<name>, and what DuckDB can say about them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.llm import ann_forest, byte_bpe, chat, hamming_search, mixing, periodic_runs, pii, quality, secret_scan, simhash, source_stripes, token_prefix, url_filter
from forgeline.llm.common import table

#: Texts over this many tokens are over the limit.
TOKEN_LIMIT = 4096
#: The rules of the URL query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words that block a host when they stand between its dots and hyphens: a general list of the trades that web corpora leave out
#: (advertising, adult, gambling, pills, loans, counterfeits, malware, spam), not drawn from any table.
HOST_WORDS = [
    "ad", "adnet", "ads", "adserver", "adult", "advert", "banner", "banners", "bet", "bets", "betting", "bingo", "cam", "cams", "casino",
    "casinos", "clickbait", "coupon", "coupons", "crack", "cracks", "dating", "doubleclick", "drugs", "erotic", "escort", "escorts", "farm", "gambling",
    "hacked", "hentai", "jackpot", "keygen", "linkfarm", "loan", "loans", "lottery", "malware", "nude", "nudes", "payday", "pharma", "phishing", "pill",
    "pills", "poker", "popup", "porn", "replica", "roulette", "sex", "slots", "spam", "sportsbook", "torrent", "tracker", "viagra", "virus", "warez", "xxx",
]


def op1_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.top_k(table(spark, sf_dir, "embeddings"), k=10, every=20)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT -1L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.examples(turns))


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _of_kind(spans: str, kind: int) -> Column:
    """How many spans are of the kind. The function takes the span alone: a second argument would be its place in the array."""
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_of_kind("base_spans", k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.said(F.col("base_spans")), 256).alias("base_sha256"), pii.said(F.col("spans")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = token_prefix.prefix_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), F.octet_length("token_steps").cast("long").alias("n_prefixes"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    hosts = spark.createDataFrame([], "host string")
    return url_filter.judge(pages, rules, hosts, spark.createDataFrame([(w,) for w in HOST_WORDS], "word string"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    both = byte_bpe.decode(ids, ranks, public_tokenizers.PATTERN)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def planted_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text): about one document in ten repeats, from a word on, the words from there over and over, as the contract says.

    With h the CRC-32 of doc_id in decimal and g = h div 10, those with h % 10 = 0 and n > 0 words repeat the p = 1 + (n - a) div (3 + g % 8)
    words from word a = g % n on.
    """
    words = F.expr(r"filter(split(text, r'[ \t-\r]+'), w -> w != '')")
    planted = F.expr("""transform(array(struct(__words AS w, __g % size(__words) AS a, 1 + (size(__words) - __g % size(__words)) DIV (3 + __g % 8) AS p)),
      x -> array_join(transform(x.w, (w, i) -> IF(i < x.a, w, x.w[CAST(x.a + (i - x.a) % x.p AS INT)])), ' '))[0]""")
    hashed = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("__h"))
    cut = hashed.select("doc_id", "text", F.expr("__h DIV 10").alias("__g"), F.when(F.col("__h") % 10 == 0, words).alias("__words"))
    return cut.select("doc_id", F.when(F.size("__words") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(planted_runs(table(spark, sf_dir, "documents")))
    both = periodic_runs.collapse(found).withColumn("best", periodic_runs.strongest(F.col("runs")))
    return both.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) DIV best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.said(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_source_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_stripes.divergences(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_of_kind("base_spans", k).alias(f"n_{kind}") for k, kind in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secret_scan.said(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.said(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_search": op1_hamming_search,
    "op2_chat": op2_chat,
    "op3_ann_forest": op3_ann_forest,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_url_filter": op9_url_filter,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_stripes": op12_source_stripes,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_hamming_search": r"""
WITH c AS (
  SELECT DISTINCT vec_id, CAST(list_reduce(list_transform(embedding[:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END::HUGEINT), lambda a, b: a * 2 + b) AS UHUGEINT) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(CAST(q.code AS UBIGINT), CAST(c.code AS UBIGINT))) AS BIGINT) AS distance
  FROM c q JOIN c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
""",
    "op2_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length('<|turn|>' || replace(role, '%', '%25') || chr(10) || '<|end|>')
    + length(replace(replace(replace(replace(replace(replace(replace(text, '%', '%25'), '<|turn|>', '%3C|turn|>'), '<|end|>', '%3C|end|>'), '<s>', '%3Cs>'), '</s>', '%3C/s>'), '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]')) AS chars,
    row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_targets
FROM c GROUP BY conv_id
""",
    "op9_url_filter": r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, first(h || p ORDER BY length(h || p) DESC) AS rule, first(v ORDER BY length(h || p) DESC) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN len(list_intersect(string_split_regex(host, '[.-]'), [{words}])) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (page_id)
""",
    "op11_periodic_runs": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT id, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [1 + ascii(x)::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: CASE WHEN x > 0 THEN xor(c, x - 1) ELSE xor(c >> 1, (c & 1) * 3988292384::UBIGINT) END) AS c FROM d),
h AS (SELECT id, CAST(xor(c, 4294967295::UBIGINT) AS BIGINT) AS h FROM b),
g AS (SELECT d.id, doc_id, w, len(w) AS n, h.h % 10 = 0 AND len(w) > 0 AS planted, h.h // 10 AS g FROM d LEFT JOIN h USING (id)),
s AS (SELECT id, doc_id, w, n, planted, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g),
m AS (SELECT id, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM s),
t AS (SELECT id, n, unnest(range(n)) AS i, unnest(w) AS word FROM m),
e AS (SELECT x.id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 3 <= x.n),
k AS (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM e),
o AS (SELECT id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT id, start, length, min(q) AS period FROM o GROUP BY id, start, length),
z AS (SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM r GROUP BY id),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(length AS DECIMAL(38, 20)) / period DESC, start, period) = 1),
x AS (SELECT id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT t.id, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN x ON t.id = x.id AND t.i = x.i GROUP BY t.id)
SELECT m.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM m LEFT JOIN z USING (id) LEFT JOIN f USING (id) LEFT JOIN c USING (id)
""",
    "op12_source_stripes": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY t.lang, t.source, term),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
p AS (SELECT k.lang, total.source, k.term, coalesce(n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v)::HUGEINT AS BIGINT) AS p
  FROM k JOIN v USING (lang) JOIN total ON total.lang = k.lang LEFT JOIN c ON c.lang = k.lang AND c.source = total.source AND c.term = k.term),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(l.total) + 5 * any_value(v))::HUGEINT AS BIGINT) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM total GROUP BY lang) l USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
term AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= 50
""",
}
ORACLE_SQL["op9_url_filter"] = ORACLE_SQL["op9_url_filter"].replace("{words}", ", ".join(f"'{w}'" for w in HOST_WORDS))
