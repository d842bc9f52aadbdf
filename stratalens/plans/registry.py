"""Registry of the engine's own queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.functions import scoring as S
from stratalens.functions import tags, vocab
from stratalens.functions import text as T
from stratalens.operators import aggregate as A
from stratalens.operators import chunks as C
from stratalens.operators import enrich as E
from stratalens.operators import graph as G
from stratalens.operators import knowledge as K
from stratalens.operators import search, sections
from stratalens.plans import more
from stratalens.plans import views as V
from stratalens.sources import sinks
from stratalens.streaming import streams

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
AS_OF = "2024-12-31"

#: The test corpus is of invented syllables; the classifier is run with words that it has.
WORDS = {"articles": ["the", "les"], "joiners": ["and", "und", "que"], "endings": ["tion", "heit"], "rare": ["worthless", "pathetic"]}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | more.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | more.oracle_sql()


def _r(c, n: int = 6):
    return F.round(c, n)


# scores ------------------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar chunks to exposures to a risk score for each company."""
    exposed = search.exposures(V.matches(spark, sf_dir), AS_OF)
    s = search.company_scores(exposed, V.companies(spark, sf_dir), 0.75, 0.0)
    return s.select("ticker", F.col("n_matches").cast("bigint").alias("n_matches"), *[_r(F.col(c)).alias(c) for c in ("raw", "sensitivity", "adjusted", "expected", "worst")], "risk_level")


_SCORES = f"""{V.EXPOSED}, {V.COMPANIES}, raws AS (SELECT ticker, count(*) AS n_matches, greatest(0.0, least(1.0, sum(similarity * weight) / (sum(weight) + 1e-12))) AS raw FROM exposed WHERE similarity >= 0 GROUP BY ticker),
scores AS (SELECT c.ticker, coalesce(n_matches, 0) AS n_matches, coalesce(raw, 0.0) AS raw, greatest(0.0, least(1.0, 0.6 * revenue_exposed + 0.3 * coalesce(margin_sensitivity, 0.2) + 0.1 * coalesce(supply_dependency, 0.0))) AS sensitivity FROM companies c LEFT JOIN raws r ON c.ticker = r.ticker)"""
_BAND = "CASE WHEN raw * sensitivity * 0.75 >= 0.75 THEN 'critical' WHEN raw * sensitivity * 0.75 >= 0.5 THEN 'high' WHEN raw * sensitivity * 0.75 >= 0.2 THEN 'medium' ELSE 'low' END"

query(f"WITH {_SCORES} SELECT ticker, n_matches, round(raw, 6) AS raw, round(sensitivity, 6) AS sensitivity, round(raw * sensitivity, 6) AS adjusted, round(raw * sensitivity * 0.75, 6) AS expected, round(raw * sensitivity, 6) AS worst, {_BAND} AS risk_level FROM scores")(flagship)


@query(f"WITH {V.MATCHES} SELECT vec_id, round(similarity, 6) AS similarity FROM matches ORDER BY matches.similarity DESC, vec_id LIMIT 50")
def cosine_topk(spark, sf_dir):
    return search.top_k(V.matches(spark, sf_dir).select("vec_id", "similarity"), 50, "vec_id").select("vec_id", _r(F.col("similarity")).alias("similarity"))


@query(f"WITH {V.MATCHES} SELECT count(*) AS n, round(avg(similarity), 6) AS avg_similarity, round(max(similarity), 6) AS max_similarity, round(min(similarity), 6) AS min_similarity FROM matches WHERE similarity >= 0.2")
def cosine_threshold_stats(spark, sf_dir):
    m = V.matches(spark, sf_dir).where(F.col("similarity") >= 0.2)
    return m.agg(F.count("*").alias("n"), *[_r(f("similarity")).alias(f"{n}_similarity") for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))])


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id < 5)
SELECT e.vec_id, round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), qe)), 6) AS max_similarity, round(avg(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), qe)), 6) AS mean_similarity FROM embeddings e, q GROUP BY e.vec_id""")
def similarity_aggregates(spark, sf_dir):
    """Maximum and mean similarity over the five vectors of a text (a stated query set)."""
    e = V.table(spark, sf_dir, "embeddings")
    q = F.broadcast(e.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")))
    return search.similarities(e, q).groupBy("vec_id").agg(_r(F.max("similarity")).alias("max_similarity"), _r(F.avg("similarity")).alias("mean_similarity"))


@query(f"WITH {V.MATCHES}, r AS (SELECT ticker, vec_id, similarity, row_number() OVER (PARTITION BY ticker ORDER BY similarity DESC, vec_id) AS rn FROM matches) SELECT ticker, vec_id, round(similarity, 6) AS similarity FROM r WHERE rn <= 3")
def knn_per_company(spark, sf_dir):
    m = V.matches(spark, sf_dir).select("ticker", "vec_id", "similarity")
    return search.top_k(m, 3, "vec_id", by=["ticker"]).withColumn("similarity", _r(F.col("similarity")))


@query("SELECT label, i - 1 AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def mean_pool_embedding(spark, sf_dir):
    p = search.mean_pool(V.table(spark, sf_dir, "embeddings"), "label")
    return p.select("label", F.col("pos").cast("bigint").alias("pos"), _r(F.col("value")).alias("value"))


@query(f"WITH {V.EXPOSED} SELECT vec_id, round(weight, 6) AS weight, round(similarity * weight, 6) AS exposure FROM exposed")
def exposure_weights(spark, sf_dir):
    x = search.exposures(V.matches(spark, sf_dir), AS_OF)
    return x.select("vec_id", _r(F.col("weight")).alias("weight"), _r(F.col("exposure")).alias("exposure"))


@query(f"WITH {V.EXPOSED}, r AS (SELECT ticker, vec_id, similarity * weight AS exposure, row_number() OVER (PARTITION BY ticker ORDER BY round(similarity * weight, 9) DESC, vec_id) AS rn FROM exposed) SELECT ticker, vec_id, round(exposure, 6) AS exposure, rn AS place FROM r WHERE rn <= 10")
def top_contributors(spark, sf_dir):
    x = search.exposures(V.matches(spark, sf_dir), AS_OF).select("ticker", "vec_id", "exposure")
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(_r(F.col("exposure"), 9)), "vec_id"))
    return x.withColumn("place", rank.cast("bigint")).where("place <= 10").withColumn("exposure", _r(F.col("exposure")))


@query(f"WITH {V.MATCHES}, t AS (SELECT * FROM matches ORDER BY similarity DESC, vec_id LIMIT 10) SELECT section_type, count(*) AS n FROM t GROUP BY section_type")
def section_breakdown(spark, sf_dir):
    return search.top_k(V.matches(spark, sf_dir), 10, "vec_id").groupBy("section_type").agg(F.count("*").alias("n"))


@query(f"WITH {V.MATCHES} SELECT section_type, filing_type, count(*) AS n, round(avg(similarity), 6) AS avg_similarity, round(max(similarity), 6) AS max_similarity, round(min(similarity), 6) AS min_similarity FROM matches GROUP BY GROUPING SETS ((), (section_type), (filing_type))")
def match_stats_grouping_sets(spark, sf_dir):
    m = search.match_statistics(V.matches(spark, sf_dir))
    return m.select("section_type", "filing_type", "n", *[_r(F.col(f"{n}_similarity")).alias(f"{n}_similarity") for n in ("avg", "max", "min")])


@query(f"""WITH {V.MATCHES}, s AS (SELECT ticker, least(avg(similarity * CASE section_type WHEN 'risk_factors' THEN 1.5 WHEN 'business' THEN 1.2 WHEN 'significant_events' THEN 1.0 ELSE 0.8 END) / 1.5, 1.0) AS score FROM matches GROUP BY ticker)
SELECT ticker, round(score, 6) AS impact_score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS impact_level FROM s""")
def legacy_impact_score(spark, sf_dir):
    return search.impact(V.matches(spark, sf_dir)).withColumn("impact_score", _r(F.col("impact_score")))


@query(f"WITH {_SCORES} SELECT ticker, {_BAND} AS risk_level, CASE {_BAND} WHEN 'critical' THEN 'reduce_weight_aggressively' WHEN 'high' THEN 'trim_position' WHEN 'medium' THEN 'monitor_closely' ELSE 'no_action' END AS action, round(CASE {_BAND} WHEN 'critical' THEN least(0.8, 0.6 * raw * sensitivity * 0.75) WHEN 'high' THEN least(0.4, 0.3 * raw * sensitivity * 0.75) ELSE 0.0 END, 6) AS reduction, {_BAND} IN ('critical', 'high') AS hedge FROM scores")
def recommendation(spark, sf_dir):
    s = search.company_scores(search.exposures(V.matches(spark, sf_dir), AS_OF), V.companies(spark, sf_dir), 0.75, 0.0)
    return s.withColumn("r", S.recommendation(F.col("expected"), F.col("risk_level"), F.lit(0.0))).select("ticker", "risk_level", "r.action", _r(F.col("r.reduction")).alias("reduction"), "r.hedge")


@query(f"""WITH {V.MATCHES}, s AS (SELECT ticker, count(*) AS n, avg(similarity) AS a, max(similarity) AS m FROM matches GROUP BY ticker) SELECT ticker, n, 'mean ' || printf('%.3f', a) || ', most ' || printf('%.3f', m) AS summary FROM s""")
def match_summary(spark, sf_dir):
    m = V.matches(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n"), F.avg("similarity").alias("a"), F.max("similarity").alias("m"))
    return m.select("ticker", "n", F.concat(F.lit("mean "), F.format_string("%.3f", "a"), F.lit(", most "), F.format_string("%.3f", "m")).alias("summary"))


_REGIONS = """rev AS (SELECT c.c_mktsegment AS sector, r.r_name AS region, sum(o.o_totalprice) AS revenue FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL)"""


@query(f"WITH {_REGIONS} SELECT sector, round(sum(CASE WHEN region IN ('ASIA', 'EUROPE') THEN revenue ELSE 0 END) / sum(revenue), 6) AS exposed FROM rev GROUP BY sector")
def revenue_exposed(spark, sf_dir):
    o, c, n, r = (V.table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rev = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("c_mktsegment").alias("sector"), F.col("r_name").alias("region")).agg(F.sum("o_totalprice").alias("revenue"))
    by = rev.groupBy("sector").agg(F.map_from_entries(F.collect_list(F.struct("region", "revenue"))).alias("m"))
    return by.select("sector", _r(S.revenue_exposed(F.col("m"), F.array(F.lit("ASIA"), F.lit("EUROPE")), F.array().cast("array<string>"))).alias("exposed"))


@query("SELECT c_mktsegment AS sector, round(avg(greatest(0.0, least(1.0, 0.6 * 0.2 + 0.3 * greatest(0.0, least(1.0, c_acctbal / 10000)) + 0.05))), 6) AS sensitivity FROM customer GROUP BY c_mktsegment")
def sensitivity_by_segment(spark, sf_dir):
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000))
    return V.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("sector")).agg(_r(F.avg(S.sensitivity(F.lit(0.2), margin, F.lit(0.5)))).alias("sensitivity"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN coalesce(value / 1000, 0.5) ELSE coalesce(value / 2000, 0.5) END AS probability FROM (SELECT event_id, event_type, value FROM events)")
def market_probability(spark, sf_dir):
    """Ticks as markets: those of type click have a Yes outcome with a price, others only their own probability."""
    e = V.table(spark, sf_dir, "events")
    outcomes = F.array(F.struct(F.when(F.col("event_type") == "click", "Yes").otherwise("No").alias("outcome"), (F.col("value") / 1000).alias("price")))
    return e.select("event_id", S.market_probability(outcomes, F.col("value") / 2000).alias("probability"))


@query("SELECT event_id, round(greatest(0.0, (p * b - (1 - p)) / b), 6) AS stake FROM (SELECT event_id, least(value / 500, 0.99) AS p, 1 + event_id % 5 AS b FROM events)")
def kelly_fraction(spark, sf_dir):
    p, b = F.least(F.col("value") / 500, F.lit(0.99)), 1 + F.col("event_id") % 5
    return V.table(spark, sf_dir, "events").select("event_id", _r(S.kelly(p, b)).alias("stake"))


# companies and filings ------------------------------------------------------------------------------------------------


@query(f"WITH {V.FILINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, source_file) AS rn FROM filings WHERE filing_type = '10-K') SELECT ticker, doc_id, CAST(filing_date AS VARCHAR) AS filing_date FROM r WHERE rn = 1")
def latest_filing(spark, sf_dir):
    f = V.filings(spark, sf_dir).select("ticker", "doc_id", "filing_date", "filing_type", "source_file").where("filing_type = '10-K'")
    return A.latest(f, ["ticker"], [F.desc("filing_date"), F.asc("source_file")]).select("ticker", "doc_id", F.col("filing_date").cast("string").alias("filing_date"))


@query(f"WITH {V.FILINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, source_file) AS rn FROM filings WHERE filing_type = '8-K') SELECT ticker, doc_id FROM r WHERE rn <= 5")
def recent_five(spark, sf_dir):
    f = V.filings(spark, sf_dir).select("ticker", "doc_id", "filing_date", "filing_type", "source_file").where("filing_type = '8-K'")
    return A.latest(f, ["ticker"], [F.desc("filing_date"), F.asc("source_file")], 5).select("ticker", "doc_id")


def _as_sections(f: DataFrame) -> DataFrame:
    sid = F.get(F.array(F.lit("item_1a"), F.lit("item_1"), F.lit("item_7"), F.lit("item_8")), (F.col("doc_id") % 4).cast("int"))
    return f.withColumn("sections", F.array(F.struct(sid.alias("section_id"), F.lit("").alias("title"), F.col("text").alias("text"))))


@query(f"""WITH {V.FILINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker, filing_type ORDER BY filing_date DESC, source_file) AS rn FROM filings), k AS (SELECT * FROM r WHERE filing_type = '10-Q' OR (filing_type = '10-K' AND rn = 1) OR (filing_type = '8-K' AND rn <= 5))
SELECT ticker, CASE WHEN filing_type = '8-K' THEN 'significant_events' WHEN filing_type = '10-K' AND doc_id % 4 = 1 THEN 'business' WHEN doc_id % 4 = 0 THEN 'risk_factors' ELSE 'other' END AS section_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM k GROUP BY ALL""")
def merge_sections(spark, sf_dir):
    m = A.merge_sections(_as_sections(V.filings(spark, sf_dir)))
    return m.groupBy("ticker", "section_type").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query(f"WITH {V.FILINGS} SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, CASE filing_type WHEN '10-K' THEN 0 WHEN '10-Q' THEN 1 ELSE 2 END, source_file) AS pos, CAST(filing_date AS VARCHAR) AS date, filing_type AS type, source_file FROM filings")
def timeline(spark, sf_dir):
    t = A.timeline(V.filings(spark, sf_dir))
    return t.withColumn("pos", F.col("pos").cast("bigint")).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {V.FILINGS} SELECT ticker, count(*) AS n_filings, count(*) FILTER (filing_type = '10-K') AS n_10k, count(*) FILTER (filing_type = '10-Q') AS n_10q, count(*) FILTER (filing_type = '8-K') AS n_8k, CAST(min(filing_date) AS VARCHAR) AS first_filing, CAST(max(filing_date) AS VARCHAR) AS last_filing, ticker AS company, md5(string_agg(source_file, '|' ORDER BY source_file)) AS sources FROM filings GROUP BY ticker")
def company_view(spark, sf_dir):
    v = A.company_view(V.filings(spark, sf_dir).withColumn("company", F.lit(None).cast("string")))
    return v.withColumns({"sources": F.md5(F.array_join("sources", "|"))} | {c: F.col(c).cast("string") for c in ("first_filing", "last_filing")})


@query(f"WITH {V.FILINGS} SELECT ticker, CAST(sum(CASE WHEN filing_type = '10-K' THEN 1 ELSE 0 END) AS BIGINT) AS k, CAST(sum(CASE WHEN filing_type = '10-Q' THEN 1 ELSE 0 END) AS BIGINT) AS q, CAST(sum(CASE WHEN filing_type = '8-K' THEN 1 ELSE 0 END) AS BIGINT) AS e FROM filings GROUP BY ticker")
def filing_counts_pivot(spark, sf_dir):
    p = V.filings(spark, sf_dir).groupBy("ticker").pivot("filing_type", ["10-K", "10-Q", "8-K"]).count().fillna(0)
    return p.toDF("ticker", "k", "q", "e")


@query("SELECT source AS ticker, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))) AS BIGINT) AS words FROM documents GROUP BY source")
def word_totals(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("ticker")).agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.sum(T.word_count(F.col("text")).cast("bigint")).alias("words"))


_HIT = " UNION ALL ".join(f"SELECT source AS ticker, '{k}' AS value FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) for k, ws in WORDS.items())


@query(f"SELECT ticker, value, count(*) AS n FROM ({_HIT}) GROUP BY ticker, value")
def keyword_tags(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("ticker"), F.explode(tags.labels(F.col("text"), WORDS)).alias("value")).groupBy("ticker", "value").agg(F.count("*").alias("n"))


@query(f"SELECT ticker, string_agg(DISTINCT value, '|' ORDER BY value) AS labels FROM ({_HIT}) GROUP BY ticker")
def tag_union(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("source").alias("ticker"), F.explode(tags.labels(F.col("text"), WORDS)).alias("v"))
    return d.groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_set("v")), "|").alias("labels"))


# text -------------------------------------------------------------------------------------------------------------------

_CLEAN = "regexp_replace(COLUMN, '\\n\\s*\\n+', ' ', 'g')"
for _p, _t in (("\\n+", " "), ("([.!?])([A-Z])", "\\1 \\2"), ("([.!?])([a-z])", "\\1 \\2"), (" +", " "), ("[^\\p{L}\\p{M}\\p{N}_\\s.,;:!?\\-()\"''%$£€]", ""), ("([a-z])([A-Z])", "\\1 \\2"), ("([0-9])([A-Za-z])", "\\1 \\2"), (" +", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_t}', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, md5({_CLEAN.replace('COLUMN', 'text')}) AS digest FROM documents")
def clean_text(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("digest"))



_HEADS = ["ITEM 1A. RISK FACTORS ", "Item 1: Business ", "item  7A - Quantitative ", "ITEM 7 Management discusses ", "Item 9 Nothing ", "ITEM 8. FINANCIAL "]
_HEADED = f"""heads AS (SELECT {_HEADS!r}::VARCHAR[] AS h), headed AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') ELSE concat(CASE WHEN doc_id % 2 = 0 THEN 'Before it all. ' ELSE '' END, h[doc_id % 6 + 1], text, ' ', h[(doc_id + 2) % 6 + 1], CASE WHEN doc_id % 5 = 0 THEN 'Short.' ELSE text END, chr(10), h[(doc_id + 3) % 6 + 1], text) END AS text FROM documents, heads)"""
_PLAIN = "|".join(p.replace("[^A]", "") for p, *_ in vocab.PLAIN_SECTIONS)
_PART_ID = "CASE " + " ".join(f"WHEN regexp_matches(part, '(?i)^(?:{p.replace('[^A]', '')})') THEN '{sid}'" for p, sid, _ in vocab.PLAIN_SECTIONS) + " END"


@query(f"""WITH {_HEADED}, parts AS (SELECT doc_id, text, unnest(string_split(regexp_replace(text, '(?i)({_PLAIN})', chr(1) || '\\1', 'g'), chr(1))) AS part, unnest(range(len(string_split(regexp_replace(text, '(?i)({_PLAIN})', chr(1) || '\\1', 'g'), chr(1))))) AS i FROM headed),
found AS (SELECT doc_id, i, {_PART_ID} AS section_id, {_CLEAN.replace('COLUMN', 'part')} AS body FROM parts), kept AS (SELECT doc_id, i, section_id, body FROM found WHERE section_id IS NOT NULL AND length(body) >= 100),
every AS (SELECT * FROM kept UNION ALL SELECT doc_id, 0, 'full_document', {_CLEAN.replace('COLUMN', 'text')} FROM headed WHERE doc_id NOT IN (SELECT doc_id FROM kept) AND regexp_matches(text, '[^\\s]'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, section_id, md5(body) AS digest, len(regexp_extract_all(body, '[^\\s]+')) AS words FROM every""")
def text_sections(spark, sf_dir):
    """Plain text with headers of forms, in and out of case, split at them; every document, whole."""
    i = F.col("doc_id")
    head = lambda k: F.get(F.array(*map(F.lit, _HEADS)), ((i + k) % 6).cast("int"))
    x = F.coalesce("text", F.lit(""))
    second = F.when(i % 5 == 0, "Short.").otherwise(x)
    headed = F.concat(F.when(i % 2 == 0, "Before it all. ").otherwise(""), head(0), x, F.lit(" "), head(2), second, F.lit("\n"), head(3), x)
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.when(i % 7 == 0, x).otherwise(headed).alias("text"))
    return sections.text_sections(rows, ["doc_id"]).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "section_id", F.md5("text").alias("digest"), F.col("word_count").cast("bigint").alias("words"))


@query("SELECT page_id, md5(" + _CLEAN.replace("COLUMN", "regexp_replace(html, '<[^>]+>', ' ', 'g')") + ") AS digest FROM pages")
def strip_tags(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("digest"))


@query("SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(F.col("text"), True)).alias("digest"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages")
def extract_title(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return p.select("page_id", T.first_match(F.col("html"), [("(?is)<title[^>]*>(.*?)</title>", 1)]).alias("title"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)).alias("host"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '2024/' || item_id WHEN item_id % 3 = 1 THEN 'H.R. ' || item_id ELSE '' END AS identifier, CASE item_id % 3 WHEN 0 THEN 'EU' WHEN 1 THEN 'US' ELSE 'UNKNOWN' END AS jurisdiction FROM benchmark")
def extract_identifier(spark, sf_dir):
    n = F.col("item_id").cast("string")
    head = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("REGULATION (EU) 2024/"), n, F.lit(" of "))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("H.R. "), n, F.lit(" to "))).otherwise("")
    b = V.table(spark, sf_dir, "benchmark").withColumn("i", T.legislation_identifier(F.concat(head, F.col("text"))))
    return b.select("item_id", "i.identifier", "i.jurisdiction")


_NAME = "CASE doc_id % 4 WHEN 0 THEN '2024-01-0' || (1 + doc_id % 9) || '-10k-AB.html' WHEN 1 THEN '2023-02-0' || (1 + doc_id % 9) || '-10-q-CDE.html' WHEN 2 THEN '2022-03-0' || (1 + doc_id % 9) || '-8-K-F.txt' ELSE 'notes-' || doc_id || '.md' END"


def _named(spark, sf_dir):
    n, d = F.col("doc_id").cast("string"), (1 + F.col("doc_id") % 9).cast("string")
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat(F.lit("2024-01-0"), d, F.lit("-10k-AB.html"))).when(k == 1, F.concat(F.lit("2023-02-0"), d, F.lit("-10-q-CDE.html"))).when(k == 2, F.concat(F.lit("2022-03-0"), d, F.lit("-8-K-F.txt"))).otherwise(F.concat(F.lit("notes-"), n, F.lit(".md")))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("input/"), name).alias("path"))


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'AB' WHEN 1 THEN 'CDE' WHEN 2 THEN 'F' ELSE '' END AS ticker, CASE doc_id % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '8-K' ELSE '10-K' END AS filing_type, regexp_extract({_NAME}, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS filing_date, CASE doc_id % 4 WHEN 0 THEN 2024 WHEN 1 THEN 2023 WHEN 2 THEN 2022 ELSE 0 END AS fiscal_year FROM documents")
def filename_fields(spark, sf_dir):
    p = F.col("path")
    return _named(spark, sf_dir).select("doc_id", T.ticker_of(p).alias("ticker"), T.filing_type_of(p).alias("filing_type"), T.date_of(p).alias("filing_date"), T.fiscal_year(T.date_of(p)).alias("fiscal_year"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1, 2) THEN 'html_filing' ELSE 'no_parser' END AS kind FROM documents")
def route_document_type(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", T.document_kind(F.col("path")).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 WHEN event_id % 4 = 1 THEN CAST(event_id AS DOUBLE) + 0.25 ELSE CAST(event_id AS DOUBLE) END AS number FROM events")
def safe_float(spark, sf_dir):
    n = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("1,"), n, F.lit(".5"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('"'), n, F.lit(',25"'))).otherwise(n)
    return V.table(spark, sf_dir, "events").select("event_id", T.safe_float(text).alias("number"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def documents_by_language(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


# chunks -----------------------------------------------------------------------------------------------------------------

_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    """A null text has no number and no digest, as in SQL."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), T.sentences(F.col("text"))).alias("s"))
    return d.select("doc_id", F.array_size("s").cast("bigint").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(f"""WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), c AS (SELECT doc_id, s, len(s) AS n, CAST(ceil(len(s) / 3.0) AS BIGINT) - CASE WHEN len(s) % 3 = 1 AND len(s) > 3 THEN 1 ELSE 0 END AS k FROM s WHERE len(s) > 0)
SELECT doc_id, g AS chunk_index, k AS total_chunks, CASE WHEN g = k - 1 THEN n - g * 3 ELSE 3 END AS sentences_in_chunk, md5(array_to_string(s[g * 3 + 1 : CASE WHEN g = k - 1 THEN n ELSE g * 3 + 3 END], ' ')) AS digest FROM (SELECT doc_id, s, n, k, unnest(range(k)) AS g FROM c)""")
def sentence_chunks(spark, sf_dir):
    c = C.sentence_chunks(V.table(spark, sf_dir, "documents"), ["doc_id"])
    return c.select("doc_id", *[F.col(x).cast("bigint").alias(x) for x in ("chunk_index", "total_chunks", "sentences_in_chunk")], F.md5("chunk_text").alias("digest"))


@query(None)
def recursive_chunks(spark, sf_dir):
    return C.split_chunks(V.table(spark, sf_dir, "documents"), ["doc_id"], size=400, overlap=50)


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_text(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x.role, F.lit(": "), x.text))
    return c.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("text"), F.count("*").alias("turns"))


@query(f"WITH {V.FILINGS} SELECT doc_id, md5('[CONTEXT]' || chr(10) || 'COMPANY: ' || ticker || ' (' || ticker || ')' || chr(10) || 'SECTION: ' || upper(section_type) || ' - ' || chr(10) || 'FILING: ' || filing_type || ' dated ' || CAST(filing_date AS VARCHAR) || chr(10) || '[CONTENT]' || chr(10) || text) AS digest FROM filings")
def enrich_header(spark, sf_dir):
    f = V.filings(spark, sf_dir)
    c = {"company": F.col("ticker"), "ticker": F.col("ticker"), "section_type": F.col("section_type"), "title": F.lit(""), "filing_type": F.col("filing_type"), "filing_date": F.col("filing_date").cast("string")}
    return f.select("doc_id", F.md5(E.section_header(F.col("text"), c)).alias("digest"))


# graph ------------------------------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT ticker AS subject, 'HAS_OPERATION' AS relation, value AS object FROM ({_HIT})")
def kg_triples_dedup(spark, sf_dir):
    e = V.table(spark, sf_dir, "documents").select(F.col("source").alias("ticker"), F.lit("operations").alias("category"), F.explode(tags.labels(F.col("text"), WORDS)).alias("value"))
    none = e.select("ticker", F.lit(None).cast("string").alias("sector"), F.lit(None).cast("string").alias("industry")).distinct()
    return G.triples(e, none)


@query("""WITH h AS (SELECT source AS ticker, doc_id, 'd' || doc_id AS title, lower(text) AS low FROM documents), v AS (SELECT ticker, w AS value, doc_id, title FROM h, (VALUES ('worthless'), ('pathetic')) t(w) WHERE contains(low, w)), r AS (SELECT *, row_number() OVER (PARTITION BY ticker, value ORDER BY doc_id) AS rn FROM v)
SELECT ticker, value, string_agg(title, '|' ORDER BY doc_id) AS evidence FROM r WHERE rn <= 5 GROUP BY ticker, value""")
def kg_evidence(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    s = d.select(F.col("source").alias("ticker"), F.col("doc_id").alias("pos"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), "text")
    e = s.select("ticker").distinct().withColumn("value", F.explode(F.array(F.lit("worthless"), F.lit("pathetic"))))
    return G.evidence(e, s).withColumn("evidence", F.array_join("evidence", "|"))


@query(f"""WITH {V.EDGES}, b AS (SELECT source AS a, target AS z FROM edges UNION SELECT target, source FROM edges), s AS (SELECT 'n' || n_nationkey AS start FROM nation), h1 AS (SELECT DISTINCT start, z AS node FROM s JOIN b ON start = a), h2 AS (SELECT DISTINCT start, z AS node FROM h1 JOIN b ON node = a)
SELECT start, node, min(hops) AS hops FROM (SELECT start, node, 1 AS hops FROM h1 UNION ALL SELECT start, node, 2 FROM h2) WHERE node <> start GROUP BY start, node""")
def kg_neighbors_depth2(spark, sf_dir):
    """From every nation: its suppliers and region, and the region's other nations."""
    start = V.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return G.reachable(V.edges(spark, sf_dir), start, 2)


@query(f"WITH {V.EDGES} SELECT DISTINCT source AS ticker FROM edges WHERE type = 'OPERATES_IN' AND target = 'n3'")
def companies_by_sector(spark, sf_dir):
    return G.companies_in_sector(V.edges(spark, sf_dir), "n3")


@query(f"WITH {V.EDGES}, l AS (SELECT 'law' || item_id AS source, 'n' || (item_id % 40) AS target FROM benchmark) SELECT source, target FROM l WHERE target IN (SELECT 'n' || n_nationkey FROM nation)")
def law_sector_link(spark, sf_dir):
    b = V.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("law"), F.col("item_id").cast("string")).alias("source"), F.concat(F.lit("n"), (F.col("item_id") % 40).cast("string")).alias("target"))
    n = V.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target"))
    return b.join(n, "target", "left_semi").select("source", "target")


@query("SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(s_name, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS balance FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def upsert_merge(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return G.upsert(c, s, ["id"])


@query("SELECT p_brand AS supplier_of, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def supply_edges(spark, sf_dir):
    lines, part = V.table(spark, sf_dir, "lineitem"), V.table(spark, sf_dir, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("supplier_of")).agg(F.count_distinct("l_suppkey").alias("suppliers"), _r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("volume"))


# knowledge --------------------------------------------------------------------------------------------------------------


def _knowledge(spark, sf_dir):
    """Customers' nations as companies: regions they are in, segments as operations."""
    c, n, r = (V.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.array().cast("array<string>")
    return rows.groupBy(F.col("n_name").alias("ticker")).agg(F.first("n_name").alias("company"), F.max("c_mktsegment").alias("sector"), F.array_sort(F.collect_set("r_name")).alias("regions"), F.array_sort(F.collect_set("c_mktsegment")).alias("operations"), none.alias("risk_types"), none.alias("keywords"), none.alias("sources"))


_KNOWN = "k AS (SELECT n_name AS ticker, max(c_mktsegment) AS sector, list_sort(list(DISTINCT r_name)) AS regions, list_sort(list(DISTINCT c_mktsegment)) AS operations FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name)"


@query(f"WITH {_KNOWN} SELECT count(*) AS n, round(avg(len(regions)), 6) AS avg_regions, round(avg(len(operations)), 6) AS avg_operations, (SELECT count(DISTINCT x) FROM (SELECT unnest(regions) AS x FROM k)) AS n_regions, (SELECT count(DISTINCT x) FROM (SELECT unnest(operations) AS x FROM k)) AS n_operations FROM k")
def knowledge_stats(spark, sf_dir):
    s = K.statistics(_knowledge(spark, sf_dir))
    return s.select("n", _r(F.col("avg_regions")).alias("avg_regions"), _r(F.col("avg_operations")).alias("avg_operations"), "n_regions", "n_operations")


@query(f"WITH {_KNOWN} SELECT ticker FROM k WHERE list_contains(regions, 'ASIA') AND list_contains(operations, 'BUILDING')")
def knowledge_search(spark, sf_dir):
    return K.search(_knowledge(spark, sf_dir), region="ASIA", operation="BUILDING").select("ticker")


@query(f"WITH {_KNOWN} SELECT ticker, array_to_string(list_sort(list_distinct(list_concat(regions, ['NEW']))), '|') AS regions, sector FROM k")
def knowledge_merge(spark, sf_dir):
    k = _knowledge(spark, sf_dir)
    return K.merge(k, k.withColumn("regions", F.array(F.lit("NEW"))).withColumn("sector", F.lit("LATER"))).select("ticker", F.array_join("regions", "|").alias("regions"), "sector")


@query("SELECT c_name AS ticker FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def checkpoint_anti(spark, sf_dir):
    """Companies without a processed entry."""
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ticker"), "c_name")
    o = V.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("ticker"), F.lit("processed").alias("status"), F.col("o_orderdate").alias("at"))
    return sinks.open_tickers(c, o).select(F.col("c_name").alias("ticker"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN CAST(label AS DOUBLE) ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def fill_missing(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding"))).withColumn("text", F.col("label").cast("string"))
    filled = sinks.fill_embeddings(e, lambda t: F.array(t.cast("float")))
    return filled.select("vec_id", _r(F.get("embedding", 0).cast("double")).alias("first"))


@query("SELECT o_orderpriority AS kind, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS successful, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS skipped FROM orders GROUP BY o_orderpriority")
def batch_counters(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", "successful").when(F.col("o_orderstatus") == "P", "failed").otherwise("skipped")
    return V.table(spark, sf_dir, "orders").withColumn("s", s).groupBy(F.col("o_orderpriority").alias("kind")).agg(*sinks.counters(F.col("s")))


# documents to rows, streams -----------------------------------------------------------------------------------------------


@query(None)
def html_sections(spark, sf_dir):
    f = V.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"), F.lit("10-K").alias("filing_type"))
    return sections.sections(f, ["page_id"]).select("page_id", "pos", "section.section_id", "section.word_count", "error")


@query(None)
def legislation_sections(spark, sf_dir):
    f = V.table(spark, sf_dir, "pages").select(F.concat(F.lit("directives/law_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return sections.legislation(f).drop("text")


@query(None)
def xml_sections(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.concat(F.lit("directives/bill_"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("path"), F.concat(F.lit("<bill><title>T</title><text>"), F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), F.lit("</text></bill>")).alias("content"))
    return sections.legislation(d).select("path", "section_id", "title", "word_count", "error")


@query(None)
def html_text(spark, sf_dir):
    return sections.plain_texts(V.table(spark, sf_dir, "pages"), ["page_id"])


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.windowed(e).withColumn("total", _r(F.col("total"), 4))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
