"""One query per training-data operator, over whole tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from callharmony.llm.conversations import damage, repair_conversations
from callharmony.llm.exact import exact_dedup
from callharmony.llm.idfiles import id_files
from callharmony.llm.jaccard import jaccard_join
from callharmony.llm.langid import identify, learn
from callharmony.llm.linechunks import drop_repeated_chunks
from callharmony.llm.mixing import mix
from callharmony.llm.packing import pack
from callharmony.llm.personal import find_personal
from callharmony.llm.phrases import collocations
from callharmony.llm.quality import quality
from callharmony.llm.tables import ship
from callharmony.llm.urls import filter_urls
from callharmony.llm.viterbi import token_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = documents(spark, sf_dir).withColumn("held_out", held_out)
    profiles = learn(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).drop("text")


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(documents(spark, sf_dir))


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLES["op4_mix_sources"] = """
WITH sizes AS (SELECT source, sum(length(text)) AS n FROM documents GROUP BY source),
shares AS (SELECT source, n, pow(n::DOUBLE, 0.7) AS share FROM sizes),
rates AS (SELECT source, sum(n) OVER () * share / sum(share) OVER () / n AS rate FROM shares),
terms AS (SELECT source, rate, k, -rate + k * ln(rate) - lgamma(k + 1) AS log_p FROM rates, range(129) AS r(k)),
cdf AS (SELECT source, list(p ORDER BY k) AS cdf FROM
  (SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS p FROM terms) GROUP BY source),
drawn AS (SELECT d.*, (('0x' || md5('0:' || doc_id || ':1')[1:13])::BIGINT + 0.5) / pow(2, 52) AS u, c.cdf
  FROM documents d JOIN cdf c USING (source)),
counted AS (SELECT * EXCLUDE (cdf, u), len(list_filter(cdf, lambda c: c < u)) AS n FROM drawn)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
       (('0x' || md5('0:place:' || doc_id || ':' || copy)[1:13])::BIGINT + 0.5) / pow(2, 52) AS place
FROM (SELECT * EXCLUDE n, unnest(range(1, n + 1)) AS copy FROM counted)
"""


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir))
    figures = {"sequences": packed.sequences, "lower_bound": packed.lower_bound}
    return packed.pieces.withColumns({name: F.lit(value).cast("long") for name, value in figures.items()})


@query
def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_chunks(documents(spark, sf_dir))


ORACLES["op6_line_chunks"] = r"""
WITH lines AS (SELECT doc_id, unnest(split) AS line, unnest(range(len(split))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS split FROM documents)),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE regexp_matches(line, '\S')),
pairs AS (SELECT doc_id, k, i, line AS above, lead(line) OVER own AS below, lead(i) OVER own AS next_i
  FROM filled WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
firsts AS (SELECT *, min(struct_pack(d := doc_id, k := k)) OVER (PARTITION BY above, below) AS first FROM pairs WHERE below IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, next_i + 1)) AS i FROM firsts
  WHERE doc_id <> first.d OR k > first.k + 1)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text,
       count(*) AS n_lines, count(g.i) AS n_removed
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).drop("text_key")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


@query
def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files(documents(spark, sf_dir))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLES["op10_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLES["op11_phrase_collocations"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
seen AS (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, range(1, 6) AS r(k) WHERE i + k - 1 <= len(w)),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS a FROM seen GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM c, range(1, 5) AS r(k) WHERE k < size),
scored AS (SELECT u.lang, u.phrase, u.size, u.a, k, x.a AS l, y.a AS r, n,
    ((1000::HUGEINT * u.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = head JOIN f y ON y.lang = u.lang AND y.phrase = tail JOIN totals t ON t.lang = u.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a AS longer, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM c, range(2, 5) AS r(k), range(1, 5) AS p(i) WHERE k < size AND i + k - 1 <= size) s
  JOIN f USING (lang, phrase) WHERE 100 * longer >= 100 * f.a),
kept AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN covered USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM kept WHERE rank <= 2000
"""


@query
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLES["op12_url_filters"] = """
WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
dotted AS (SELECT *, '.' || host AS h FROM split),
ruled AS (SELECT *, CASE WHEN h LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN h LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN h LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN h LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM dotted)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN path LIKE '/search/help%' THEN 'allow'
  WHEN (h LIKE '%.ads.%' OR h LIKE '%.tracker.%') AND path LIKE '/%' THEN 'block'
  WHEN path LIKE '/cgi-bin/%' OR path LIKE '/%/login%' OR path LIKE '/login%' OR path LIKE '/search%' OR path LIKE '/tag_/%' THEN 'block'
  WHEN path LIKE '%.exe%' OR path LIKE '%.zip%' OR path LIKE '%.jpg%' OR path LIKE '%.png%' THEN 'block'
  ELSE 'allow' END AS verdict FROM ruled
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(damage(rows), rows)
