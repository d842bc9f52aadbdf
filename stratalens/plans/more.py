"""Further queries of the engine, each with its SQL twin: knowledge, graph, impact, chunks and sources."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import tags, vocab
from stratalens.functions import text as T
from stratalens.operators import aggregate as A
from stratalens.operators import chunks as C
from stratalens.operators import documents, enrich, impact, language, search, service, vectors
from stratalens.operators import graph as G
from stratalens.operators import knowledge as K
from stratalens.plans import prose as P
from stratalens.plans import views as V
from stratalens.sources import readers, sinks, tables
from stratalens.sources.tables import shared
from stratalens.streaming import latest, streams

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
AS_OF = "2024-12-31"


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c, n: int = 6):
    return F.round(c, n)


def _joined(c):
    return F.array_join(c, "|")


# real vocabularies ------------------------------------------------------------------------------------------------------


@query(f"WITH {P.PROSE} SELECT * FROM ({P.ENTITIES})")
def filing_entities(spark, sf_dir):
    """Countries, operations and risk types of filings by the real vocabularies."""
    return A.entities(P.filings(spark, sf_dir).select("ticker", "text", F.lit("Risk Factors").alias("title")))


@query(f"""WITH {P.PROSE} SELECT ticker, {P.knowledge_list(vocab.REGIONS)} AS regions, {P.knowledge_list(vocab.OPERATIONS)} AS operations,
 {P.knowledge_list(vocab.RISKS)} AS risk_types, count(DISTINCT source_file) AS n_sources FROM prose GROUP BY ticker""")
def knowledge_from_filings(spark, sf_dir):
    k = K.from_sections(P.filings(spark, sf_dir))
    return k.select("ticker", *[_joined(c).alias(c) for c in ("regions", "operations", "risk_types")], F.size("sources").cast("bigint").alias("n_sources"))


_ENRICHED = f"""'[CONTEXT]' || chr(10) || 'COMPANY: ' || ticker || ' (' || ticker || ')' || chr(10) || 'SECTOR: Technology' || chr(10) || 'SECTION: ' || section_type || chr(10)
 || 'REGIONS_MENTIONED: ' || array_to_string(list_sort(list_distinct(list_concat(['EU'], {P.labels("text", vocab.REGIONS)}))), ', ')
 || CASE WHEN len({P.labels("text", vocab.OPERATIONS)}) > 0 THEN chr(10) || 'OPERATIONS: ' || array_to_string({P.labels("text", vocab.OPERATIONS)}, ', ') ELSE '' END
 || CASE WHEN len({P.labels("text", vocab.RISKS)}) > 0 THEN chr(10) || 'RISK_TYPES: ' || array_to_string({P.labels("text", vocab.RISKS)}, ', ') ELSE '' END
 || chr(10) || chr(10) || '[CONTENT]' || chr(10) || text"""


@query(f"WITH {P.PROSE} SELECT doc_id, md5({_ENRICHED}) AS digest FROM prose")
def enrich_filing_chunks(spark, sf_dir):
    f = P.filings(spark, sf_dir).select("doc_id", "ticker", F.col("section_type").alias("section_title"), "text")
    none = F.array().cast("array<string>")
    k = f.select("ticker").distinct().select("ticker", F.col("ticker").alias("company"), F.lit("Technology").alias("sector"), F.array(F.lit("EU")).alias("regions"), none.alias("operations"), none.alias("risk_types"))
    return enrich.filing_chunks(f, k).select("doc_id", F.md5("enriched_text").alias("digest"))


_EDGES = " UNION ".join(
    f"SELECT ticker AS source, unnest(regexp_extract_all(text, '{pattern}', 1)[1:3]) AS target, '{relation}' AS type FROM prose" for pattern, relation in vocab.RELATIONS
)


@query(f"WITH {P.PROSE}, e AS ({_EDGES}) SELECT source, target, type, 0.6 AS confidence FROM e WHERE length(target) > 2")
def kg_edges_pattern(spark, sf_dir):
    return G.pattern_edges(P.filings(spark, sf_dir)).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"WITH {P.PROSE} SELECT doc_id, array_to_string({P.labels('text', vocab.AREAS)}, '|') AS areas, array_to_string({P.labels('text', vocab.PROFILE_RISKS)}, '|') AS risks FROM prose")
def vocabulary_labels(spark, sf_dir):
    named = tags.labels_of(F.col("text"), {"areas": vocab.AREAS, "risks": vocab.PROFILE_RISKS})
    return P.filings(spark, sf_dir).select("doc_id", named.alias("n")).select("doc_id", _joined(F.col("n.areas")).alias("areas"), _joined(F.col("n.risks")).alias("risks"))


@query("""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[^\\s]{6,}'))) AS w FROM benchmark),
h AS (SELECT doc_id, w FROM (SELECT doc_id, lower(text) AS low FROM documents) d JOIN w ON contains(low, w))
SELECT d.doc_id, count(h.w) AS n, md5(coalesce(string_agg(h.w, '|' ORDER BY encode(h.w)), '')) AS digest FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id""")
def dictionary_labels(spark, sf_dir):
    """A dictionary of more than a thousand keywords, the long words of the benchmark's items: texts are read once."""
    words = V.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\s]{6,}"), F.lit(0))).alias("w")).distinct()
    vocabulary = {r["w"]: [r["w"]] for r in words.collect()}  # a dictionary: as many as the benchmark's words, whatever the texts
    found = V.table(spark, sf_dir, "documents").select("doc_id", tags.labels(F.col("text"), vocabulary).alias("l"))
    return found.select("doc_id", F.size("l").cast("bigint").alias("n"), F.md5(_joined(F.col("l"))).alias("digest"))


_WORDS = {"en": ["the", "and", "of", "to", "in"], "fr": ["le", "la", "les", "des", "et"], "de": ["der", "die", "und", "das", "den"], "es": ["el", "los", "las", "que", "y"]}
_HITS = ", ".join(f"struct_pack(n := {' + '.join(f'len(string_split(head, $ {w} $)) - 1'.replace('$ ', chr(39) + ' ').replace(' $', ' ' + chr(39)) for w in ws)}, o := {-i}, lang := '{k}')" for i, (k, ws) in enumerate(_WORDS.items()))


@query(f"WITH h AS (SELECT doc_id, ' ' || lower(substring(coalesce(text, ''), 1, 1000)) || ' ' AS head FROM documents) SELECT doc_id, CASE WHEN regexp_matches(head, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(head, '[一-鿿]') THEN 'zh' ELSE greatest({_HITS}).lang END AS language FROM h")
def detect_language(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


@query("""WITH RECURSIVE s AS (SELECT doc_id, unnest(parts) AS s, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)),
n AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, len(regexp_extract_all(s, '[^\\s]+')) AS k FROM s WHERE s <> ''),
g AS (SELECT doc_id, i, k, k AS held, 0 AS g FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, n.k, CASE WHEN g.held + n.k > 400 THEN n.k ELSE g.held + n.k END, CASE WHEN g.held + n.k > 400 THEN g.g + 1 ELSE g.g END FROM g JOIN n ON n.doc_id = g.doc_id AND n.i = g.i + 1),
c AS (SELECT g.doc_id, g.g, md5(string_agg(n.s, ' ' ORDER BY g.i)) AS digest FROM g JOIN n USING (doc_id, i) GROUP BY g.doc_id, g.g)
SELECT doc_id, g AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, digest FROM c""")
def word_pack_chunks(spark, sf_dir):
    c = C.split_chunks(V.table(spark, sf_dir, "documents"), ["doc_id"], size=400, unit="words")
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("total_chunks").cast("bigint").alias("total_chunks"), F.md5("chunk_text").alias("digest"))


# vectors ----------------------------------------------------------------------------------------------------------------

_PAIRS = """p AS (SELECT q.vec_id AS query, e.vec_id AS key, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity, q.label AS asked FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)"""


def _search(spark, sf_dir, label: str | None) -> DataFrame:
    e = V.table(spark, sf_dir, "embeddings")
    index = vectors.build(e, f"{shared(spark)}/vectors-{uuid.uuid4().hex}", label=label)
    found = vectors.search(index, e.where("vec_id % 50 = 0"), 10, label=label)
    return found.select("query", "rank", _r(F.col("similarity")).alias("similarity"))


@query(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key) AS rank FROM p) SELECT query, CAST(rank AS INTEGER) AS rank, similarity FROM r WHERE rank <= 10")
def indexed_topk(spark, sf_dir):
    """The ten vectors nearest to each fiftieth one, by the index; every vector is indexed."""
    return _search(spark, sf_dir, None)


@query(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key) AS rank FROM p WHERE label = asked) SELECT query, CAST(rank AS INTEGER) AS rank, similarity FROM r WHERE rank <= 10")
def indexed_topk_in_label(spark, sf_dir):
    """The same among vectors of the query's own label."""
    return _search(spark, sf_dir, "label")


# stored tables and streams ------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT coalesce(source, '-') AS source, CASE WHEN lang IN ('de', 'fr') THEN coalesce(md5(text), 'none') ELSE lang END AS lang FROM documents)
SELECT source, count(*) AS n, md5(string_agg(lang, ',' ORDER BY lang)) AS langs, (SELECT count(*) FROM documents WHERE source = 's1') AS deleted, (SELECT count(*) FROM documents WHERE lang IN ('de', 'fr')) AS filled FROM d WHERE source <> 's1' GROUP BY source""")
def stored_maintenance(spark, sf_dir):
    """Documents in a stored table by source: missing values filled, one source deleted, and both counted."""
    table = tables.Table(spark, f"{shared(spark)}/stored-{uuid.uuid4().hex}", "doc_id bigint, source string, text string, lang string", "source")
    table.append(V.table(spark, sf_dir, "documents").withColumn("lang", F.when(~F.col("lang").isin("de", "fr"), F.col("lang"))))
    filled = table.fill("lang", F.coalesce(F.md5("text"), F.lit("none")))
    deleted = table.delete(F.col("source") == "s1", ["s1"])
    rows = table.read().groupBy(F.coalesce("source", F.lit("-")).alias("source")).agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("lang")), ",")).alias("langs"))
    return rows.withColumn("deleted", F.lit(deleted).cast("bigint")).withColumn("filled", F.lit(filled).cast("bigint"))


@query("""SELECT 'U' || CAST(user_id % 200 AS VARCHAR) AS ticker, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS filing_date, arg_max(lpad(CAST(event_id AS VARCHAR), 12, '0'), CAST(CAST(ts AS DATE) AS VARCHAR) || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS source_file,
 arg_max(event_type, CAST(CAST(ts AS DATE) AS VARCHAR) || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS filing_type, count(*) AS n_filings FROM events GROUP BY 1""")
def latest_state(spark, sf_dir):
    """A stream of events as filings: each user's latest one, kept as state, stored batch by batch."""
    root = f"{shared(spark)}/latest-{uuid.uuid4().hex}"
    table = tables.Table(spark, f"{root}/rows", f"{latest.OUT}, batch bigint", "status")
    events = streams.event_stream(spark, f"{sf_dir}/events*.parquet")
    filings = events.select(F.concat(F.lit("U"), (F.col("user_id") % 200).cast("string")).alias("ticker"), F.to_date("ts").alias("filing_date"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("source_file"), F.col("event_type").alias("filing_type"), F.col("ts").alias("arrived"))
    with latest.state_store(spark):
        rows = latest.latest_filings(filings, 400 * 86_400).writeStream.outputMode("update")
        rows.foreachBatch(lambda df, n: table.append(df.withColumn("batch", F.lit(n)), ("latest", n)) and None).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = table.read().where("status = 'latest'").groupBy("ticker").agg(F.max_by(F.struct("filing_date", "source_file", "filing_type", "n_filings"), "batch").alias("l"))
    return last.select("ticker", F.col("l.filing_date").cast("string").alias("filing_date"), "l.source_file", "l.filing_type", "l.n_filings")


# graph ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {V.EDGES}, l AS (SELECT target AS subject, type, string_agg(source, ',' ORDER BY source) AS objects FROM edges GROUP BY target, type) SELECT subject, string_agg(type || '=' || objects, ';' ORDER BY type) AS relations FROM l GROUP BY subject")
def kg_relations_map(spark, sf_dir):
    """What a company's context says of it: relation to objects."""
    t = V.edges(spark, sf_dir).select(F.col("target").alias("subject"), F.col("type").alias("relation"), F.col("source").alias("object"))
    entry = F.transform(F.array_sort(F.map_entries("relations")), lambda e: F.concat(e.key, F.lit("="), F.array_join(e.value, ",")))
    return enrich.relations(t).select("subject", F.array_join(entry, ";").alias("relations"))


@query("""WITH n AS (SELECT 's' || CAST(s_suppkey % 40 AS VARCHAR) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Company' ELSE 'Supplier' END AS label, s_suppkey AS ord, 'k' || CAST(s_suppkey % 2 AS VARCHAR) AS key, s_name AS value FROM supplier),
p AS (SELECT id, key, arg_max(value, ord) AS value FROM n GROUP BY id, key), f AS (SELECT id, arg_min(label, ord) AS label FROM n GROUP BY id)
SELECT id, label, string_agg(key || '=' || value, ',' ORDER BY key) AS properties FROM p JOIN f USING (id) GROUP BY id, label""")
def kg_merge_nodes(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier")
    label = F.when(F.col("s_suppkey") % 3 == 0, "Company").otherwise("Supplier")
    key = F.concat(F.lit("k"), (F.col("s_suppkey") % 2).cast("string"))
    n = s.select(F.concat(F.lit("s"), (F.col("s_suppkey") % 40).cast("string")).alias("id"), label.alias("label"), F.col("s_suppkey").alias("ord"), F.create_map(key, "s_name").alias("properties"))
    props = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e.key, F.lit("="), e.value))
    return G.merge_nodes(n, "ord").select("id", F.get("labels", 0).alias("label"), F.array_join(props, ",").alias("properties"))


@query(f"WITH {V.EDGES}, n AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT 'n' || CAST(n_nationkey AS VARCHAR) FROM nation) SELECT type, count(*) AS created FROM edges WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) GROUP BY type")
def kg_created_relations(spark, sf_dir):
    """Relations count as created only where both ends exist."""
    s, n = V.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0"), V.table(spark, sf_dir, "nation")
    nodes = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")).union(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))
    return G.created(V.edges(spark, sf_dir), nodes)


_NEAR = f"""{V.EDGES}, b AS (SELECT source AS x, target AS y FROM edges UNION SELECT target, source FROM edges),
one AS (SELECT DISTINCT 'r' || CAST(r_regionkey AS VARCHAR) AS start, y AS node FROM region JOIN b ON x = 'r' || CAST(r_regionkey AS VARCHAR)),
inner_ AS (SELECT start, node FROM one UNION SELECT DISTINCT start, start FROM one), two AS (SELECT start, node FROM one UNION SELECT start, y FROM one JOIN b ON x = node WHERE y <> start),
rel AS (SELECT DISTINCT start, source, type, target FROM inner_ JOIN edges ON node = source OR node = target)"""


@query(f"WITH {_NEAR}, n AS (SELECT start, string_agg(node, ',' ORDER BY node) AS nodes FROM two GROUP BY start), l AS (SELECT start, string_agg(source || '-' || type || '-' || target, ',' ORDER BY source, type, target) AS relations FROM rel GROUP BY start) SELECT start, md5(nodes) AS nodes, md5(relations) AS relations FROM n JOIN l USING (start)")
def kg_context(spark, sf_dir):
    """Nodes and relations within two steps of each region."""
    start = V.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    c = G.context(V.edges(spark, sf_dir), start, 2)
    relations = F.transform("relations", lambda e: F.concat_ws("-", e.source, e.type, e.target))
    return c.select("start", F.md5(F.array_join("nodes", ",")).alias("nodes"), F.md5(F.array_join(relations, ",")).alias("relations"))


@query(f"""WITH {V.EDGES} SELECT 0 AS ord, 'CREATE (n:Nation {{id: ''n' || CAST(n_nationkey AS VARCHAR) || ''', name: ''' || replace(n_name, '_', '''_') || '''}})' AS statement FROM nation
UNION ALL SELECT 1, 'MATCH (a {{id: ''' || source || '''}}), (b {{id: ''' || target || '''}}) CREATE (a)-[:' || type || ']->(b)' FROM edges""".replace("replace(n_name, '_', '''_')", "replace(n_name, '_', chr(92) || '''')"))
def graph_cypher(spark, sf_dir):
    """Statements for nodes, whose names hold a quote to escape, and for relations."""
    n = V.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.array(F.lit("Nation")).alias("labels"), F.create_map(F.lit("name"), F.replace("n_name", F.lit("_"), F.lit("'"))).alias("properties"))
    return G.cypher(n, V.edges(spark, sf_dir))


_LINKS = """links AS (SELECT DISTINCT source, target FROM (
 SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS source, 'n' || CAST(n_nationkey AS VARCHAR) AS target FROM nation
 UNION ALL SELECT 'n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR) FROM supplier
 UNION ALL SELECT 's' || CAST(l_suppkey AS VARCHAR), 'o' || CAST(l_orderkey AS VARCHAR) FROM lineitem
 UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'c' || CAST(o_custkey AS VARCHAR) FROM orders
 UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'p' || o_orderpriority FROM orders))"""


@query(f"""WITH RECURSIVE {_LINKS}, e AS (SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links), d AS (SELECT a, count(*) AS n FROM e GROUP BY a),
w(start, node, hops) AS (SELECT DISTINCT 'r' || CAST(n_regionkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), 0 FROM nation
 UNION SELECT w.start, e.b, w.hops + 1 FROM w JOIN e ON e.a = w.node JOIN d ON d.a = w.node WHERE w.hops < 6 AND (w.hops = 0 OR d.n <= 1000)),
m AS (SELECT start, node, min(hops) AS hops FROM w GROUP BY start, node)
SELECT m.start, m.hops, count(*) AS n, CAST(count_if(d.n > 1000) AS BIGINT) AS hubs, md5(string_agg(m.node, ',' ORDER BY m.node)) AS digest FROM m JOIN d ON d.a = m.node WHERE m.hops > 0 GROUP BY m.start, m.hops""")
def kg_reach_depth6(spark, sf_dir):
    """What lies within six steps of each region in a graph of suppliers, orders and customers; the priorities of
    orders are hubs, met and not passed through."""
    t = lambda name: V.table(spark, sf_dir, name)
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    link = lambda name, a, b: t(name).select(node(*a).alias("source"), node(*b).alias("target"))
    links = link("nation", ("r", "n_regionkey"), ("n", "n_nationkey")).union(link("supplier", ("n", "s_nationkey"), ("s", "s_suppkey"))).union(link("lineitem", ("s", "l_suppkey"), ("o", "l_orderkey")))
    links = links.union(link("orders", ("o", "o_orderkey"), ("c", "o_custkey"))).union(link("orders", ("o", "o_orderkey"), ("p", "o_orderpriority")))
    start = t("nation").select(node("r", "n_regionkey").alias("id"))
    met = G.expand(links, start, 6, most_degree=1000)
    return met.groupBy("start", "hops").agg(F.count("*").alias("n"), F.count_if("hub").alias("hubs"), F.md5(F.array_join(F.array_sort(F.collect_list("node")), ",")).alias("digest"))


_GRAMS = "g AS (SELECT doc_id, lang, crc, unnest(list_transform(range(1, greatest(length(low) - 1, 1)), lambda i: substring(low, i, 3))) AS gram FROM (SELECT doc_id, lang, doc_id % 5 AS crc, lower(coalesce(text, '')) AS low FROM documents)), f AS (SELECT * FROM g WHERE length(gram) = 3)"


@query(f"""WITH {_GRAMS}, c AS (SELECT lang, gram, count(*) AS n FROM f WHERE crc <> 1 AND lang IS NOT NULL GROUP BY lang, gram),
t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang), b AS (SELECT gram FROM c GROUP BY gram ORDER BY sum(n) DESC, unicode(gram), unicode(gram[2:]), unicode(gram[3:]) LIMIT 20000),
m AS (SELECT gram, lang, ln((coalesce(n, 0) + 1) / (total + (SELECT count(*) FROM b) + 1)) AS s FROM b CROSS JOIN t LEFT JOIN c USING (gram, lang)),
o AS (SELECT lang, ln(1 / (total + (SELECT count(*) FROM b) + 1)) AS s FROM t), h AS (SELECT doc_id, gram, count(*) AS n FROM f GROUP BY doc_id, gram),
x AS (SELECT h.doc_id, o.lang, sum(h.n * coalesce(m.s, o.s)) AS score FROM h CROSS JOIN o LEFT JOIN m ON m.gram = h.gram AND m.lang = o.lang GROUP BY h.doc_id, o.lang)
SELECT d.doc_id, arg_max(x.lang, x.score) AS language FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id GROUP BY d.doc_id""")
def learned_language(spark, sf_dir):
    """Every document's language by trigram profiles that four fifths of the documents have taught."""
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", language.detect(F.col("text"), language.fit(d.where("doc_id % 5 <> 1"))).alias("language"))


# impact -----------------------------------------------------------------------------------------------------------------

_IMPACT = f"""{V.EXPOSED}, {V.COMPANIES}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY similarity DESC, vec_id) AS rn FROM exposed),
m AS (SELECT * FROM r WHERE rn <= 20 AND similarity >= 0.05),
a AS (SELECT ticker, count(*) AS total, avg(similarity) AS a, max(similarity) AS b, min(similarity) AS c, greatest(0.0, least(1.0, sum(similarity * weight) / (sum(weight) + 1e-12))) AS raw, arg_min(vec_id, rn) AS first FROM m GROUP BY ticker),
s AS (SELECT c.ticker, a.*, coalesce(raw, 0.0) * greatest(0.0, least(1.0, 0.6 * revenue_exposed + 0.3 * coalesce(margin_sensitivity, 0.2) + 0.1 * coalesce(supply_dependency, 0.0))) * 0.9 AS expected FROM companies c LEFT JOIN a ON a.ticker = c.ticker),
t AS (SELECT 'T' || CAST(id AS VARCHAR) AS ticker FROM range(12) u(id))"""


@query(f"""WITH {_IMPACT} SELECT t.ticker, CAST(coalesce(total, 0) AS BIGINT) AS total_matches, round(CASE WHEN s.ticker IS NOT NULL THEN coalesce(a, 0) END, 6) AS avg_similarity, round(CASE WHEN s.ticker IS NOT NULL THEN coalesce(b, 0) END, 6) AS max_similarity,
 round(coalesce(expected, 0), 6) AS expected, CASE WHEN s.ticker IS NULL THEN 'unknown' WHEN expected >= 0.75 THEN 'critical' WHEN expected >= 0.5 THEN 'high' WHEN expected >= 0.2 THEN 'medium' ELSE 'low' END AS risk_level,
 CAST(first AS VARCHAR) AS first_id, CASE WHEN first IS NOT NULL THEN CAST(CASE WHEN first % 7 = 0 THEN 1 ELSE first % 50 + 1 END AS VARCHAR) || CASE WHEN first % 5 = 0 THEN '' ELSE ' of ' || CAST(first % 5 * 20 AS VARCHAR) END END AS first_position,
 CASE WHEN s.ticker IS NOT NULL THEN 'Risk Level: ' || CASE WHEN expected >= 0.75 THEN 'CRITICAL' WHEN expected >= 0.5 THEN 'HIGH' WHEN expected >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END || ', Score: ' || printf('%.3f', expected) END AS summary FROM t LEFT JOIN s ON s.ticker = t.ticker""")
def analyze_impact(spark, sf_dir):
    """All companies in one plan; one that is asked for and not known is unknown; numbers that come as text or not at all."""
    i = F.col("vec_id")
    m = V.matches(spark, sf_dir).select(
        i.alias("id"), "ticker", "similarity", "section_type", F.initcap("section_type").alias("section_title"), "filing_type", "filing_date", "text",
        F.when(i % 7 == 0, "n/a").otherwise((i % 50).cast("string")).alias("sentence_idx"), F.when(i % 5 != 0, i % 5 * 20).alias("total_sentences"),
    )
    companies = V.companies(spark, sf_dir).withColumn("company", F.concat(F.lit("Company "), "ticker"))
    asked = spark.range(12).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"))
    x = impact.analyze(m, companies, "HR-1", AS_OF, 0.9, 20, 0.05, asked)
    first = F.get("matches", 0)
    return x.select("ticker", F.col("total_matches").cast("bigint").alias("total_matches"), *[_r(F.col(c)).alias(c) for c in ("avg_similarity", "max_similarity", "expected")], "risk_level", first["id"].cast("string").alias("first_id"), first["sentence_position"].alias("first_position"), "details.summary")


@query(f"WITH {V.MATCHES} SELECT section_type, count(*) AS n, round(avg(similarity), 6) AS avg_similarity, round(max(similarity), 6) AS max_similarity, (SELECT round(avg(similarity), 6) FROM matches) AS overall, (SELECT string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY similarity DESC, vec_id) FROM (SELECT * FROM matches ORDER BY similarity DESC, vec_id LIMIT 10)) AS top FROM matches GROUP BY section_type")
def similarity_report(spark, sf_dir):
    x = impact.report(V.matches(spark, sf_dir).withColumnRenamed("vec_id", "id"))
    x = x.select(_r(F.col("avg_similarity")).alias("overall"), F.array_join(F.transform("top", lambda m: m.id.cast("string")), ",").alias("top"), F.explode("by_section").alias("s"))
    return x.select("s.section_type", F.col("s.count").alias("n"), _r(F.col("s.avg_similarity")).alias("avg_similarity"), _r(F.col("s.max_similarity")).alias("max_similarity"), "overall", "top")


# chunks and knowledge ---------------------------------------------------------------------------------------------------

_TITLES = ["Item 1A. Risk Factors", "Item 1. Business", "Item 7. Management", "Overview of MD&A", "Business and Risk Factors", "Properties"]


@query(f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'item_1a' WHEN 1 THEN 'item_1' WHEN 2 THEN 'item_7' WHEN 3 THEN 'item_7' WHEN 4 THEN 'item_1a' ELSE 'other' END AS section_type, 'N/A' AS filing_type, '' AS filing_date, 0 AS sentence_idx, 1 AS total_sentences FROM documents""")
def warehouse_rows(spark, sf_dir):
    title = F.get(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % 6).cast("int"))
    none = F.lit(None).cast("string")
    d = V.table(spark, sf_dir, "documents").select("doc_id", title.alias("section_title"), "text", none.alias("filing_type"), none.alias("filing_date"), F.lit(None).cast("int").alias("chunk_index"), F.lit(1).alias("total_chunks"))
    return documents.warehouse(d).drop("section_title", "text", "original_sentence")


@query("WITH o AS (SELECT o_custkey AS ticker, 'k' || CAST(o_orderkey % 3 AS VARCHAR) AS key, CAST(max(o_orderkey) AS VARCHAR) AS value, o_orderstatus = 'F' AS old FROM orders GROUP BY ALL), l AS (SELECT ticker, key, arg_max(value, CASE WHEN old THEN 0 ELSE 1 END) AS value FROM o GROUP BY ticker, key) SELECT CAST(ticker AS VARCHAR) AS ticker, string_agg(key || '=' || value, ',' ORDER BY key) AS metadata FROM l GROUP BY ticker")
def knowledge_refresh(spark, sf_dir):
    """Metadata of two states of the knowledge table: the newer value of a key wins."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), F.concat(F.lit("k"), (F.col("o_orderkey") % 3).cast("string")).alias("key"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("old"))

    def state(rows: DataFrame) -> DataFrame:
        values = rows.groupBy("ticker", "key").agg(F.max("o_orderkey").cast("string").alias("value"))
        data = values.groupBy("ticker").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
        none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
        return data.select("ticker", text.alias("company"), text.alias("sector"), *[none.alias(c) for c in K.LISTS], none.alias("sources"), "metadata")

    x = K.refresh(state(o.where("old")), state(o.where("NOT old")))
    entry = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e.key, e.value))
    return x.select("ticker", F.array_join(entry, ",").alias("metadata"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS ticker, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 4 <> 0) AS company, arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS sector FROM orders GROUP BY o_custkey")
def provider_cascade(spark, sf_dir):
    """Each field from the best provider that has it."""
    k = F.col("o_orderkey")
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("ticker"), k.alias("rank"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("company"), F.when(k % 3 != 0, F.col("o_orderstatus")).otherwise("").alias("sector"))
    return K.best_fields(o, ["company", "sector"])


# sources ----------------------------------------------------------------------------------------------------------------


def _paths(spark, sf_dir) -> DataFrame:
    """Paths of files, made of doc_id: raw filings, parsed ones flat and by ticker, and others."""
    i = F.col("doc_id")
    t = F.concat(F.lit("TK"), F.chr(65 + i % 7))
    path = (
        F.when(i % 5 == 0, F.concat(F.lit("input/filings/"), t, F.lit("/2024-01-02-10-k-"), t, F.lit(".html")))
        .when(i % 5 == 1, F.concat(F.lit("parsed/"), i.cast("string"), F.lit("_"), t, F.lit("_10k.json")))
        .when(i % 5 == 2, F.concat(F.lit("parsed/filings/"), t, F.lit("/"), i.cast("string"), F.lit("_10q.json")))
        .when(i % 5 == 3, F.concat(F.lit("input/filings/"), t, F.lit("/2024-05-06-8-k.txt")))
        .otherwise(F.concat(F.lit("other/"), i.cast("string"), F.lit(".csv")))
    )
    return V.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


_PATHS = """p AS (SELECT doc_id, 'TK' || chr(CAST(65 + doc_id % 7 AS INTEGER)) AS t FROM documents), paths AS (SELECT doc_id, t, CASE doc_id % 5 WHEN 0 THEN 'input/filings/' || t || '/2024-01-02-10-k-' || t || '.html' WHEN 1 THEN 'parsed/' || CAST(doc_id AS VARCHAR) || '_' || t || '_10k.json'
 WHEN 2 THEN 'parsed/filings/' || t || '/' || CAST(doc_id AS VARCHAR) || '_10q.json' WHEN 3 THEN 'input/filings/' || t || '/2024-05-06-8-k.txt' ELSE 'other/' || CAST(doc_id AS VARCHAR) || '.csv' END AS path FROM p)"""


@query(f"WITH {_PATHS} SELECT t AS ticker, path FROM paths WHERE doc_id % 5 = 0")
def raw_filings(spark, sf_dir):
    return readers.raw_filings(_paths(spark, sf_dir).select("path"))


@query(f"WITH {_PATHS} SELECT t AS ticker, path FROM paths WHERE doc_id % 5 = 1 AND t <> 'TKG' UNION ALL SELECT t, path FROM paths WHERE doc_id % 5 = 2 AND t <> 'TKG' AND t NOT IN (SELECT t FROM paths WHERE doc_id % 5 = 1)")
def parsed_filings(spark, sf_dir):
    wanted = spark.range(6).select(F.concat(F.lit("TK"), F.chr(65 + F.col("id"))).alias("ticker"))
    return readers.parsed_filings(_paths(spark, sf_dir).select("path"), wanted)


@query(f"WITH {_PATHS} SELECT CASE doc_id % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K' WHEN 2 THEN '10-Q' WHEN 3 THEN '8-K' END AS filing_type, count(*) AS files, CAST(count_if(contains(lower(path), '10k')) AS BIGINT) AS annual FROM paths WHERE doc_id % 5 < 4 GROUP BY 1")
def downloads_by_type(spark, sf_dir):
    p = _paths(spark, sf_dir).where("doc_id % 5 < 4")
    annual = p.groupBy(T.filing_type_of(F.col("path")).alias("filing_type")).agg(F.count_if(T.is_annual(F.col("path"))).alias("annual"))
    return readers.downloads(p).join(annual, "filing_type")


@query("SELECT ticker FROM (SELECT DISTINCT upper(c_mktsegment) || '.' || CAST(c_nationkey AS VARCHAR) AS ticker FROM customer) ORDER BY ticker LIMIT 7")
def first_tickers(spark, sf_dir):
    """Tickers of a list, cleaned, and the first seven."""
    c = V.table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(","), F.col("c_nationkey").cast("string")).alias("Symbol"))
    return readers.at_most(readers.tickers(c), 7, "ticker")


@query("SELECT count(*) AS total, CAST(count_if(event_type = 'purchase') AS BIGINT) AS successful, CAST(count_if(event_type = 'error') AS BIGINT) AS failed, CAST(count_if(event_type = 'view') AS BIGINT) AS skipped, round(count_if(event_type = 'purchase') * 100 / count(*), 1) AS success_rate FROM events")
def batch_summary(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "successful").when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("other")
    return sinks.summary(V.table(spark, sf_dir, "events").select(status.alias("status")))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Risk Factors' WHEN 1 THEN 'Section' WHEN 2 THEN 'Legal' ELSE 'Business' END AS title FROM documents""")
def titles_of_matches(spark, sf_dir):
    m = F.get(F.array(*map(F.lit, ["ITEM 1A. RISK FACTORS", "Item 7", "item 3: legal", "BUSINESS"])), (F.col("doc_id") % 4).cast("int"))
    return V.table(spark, sf_dir, "documents").select("doc_id", T.title_of_match(m).alias("title"))


@query("SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_'']+'), lambda w: lower(w) NOT IN ('the', 'and', 'of')), ' ')) AS digest FROM documents")
def content_words(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.content_words(F.col("text"), ["the", "and", "of"])).alias("digest"))


@query("WITH c AS (SELECT c_custkey AS id, 'T' || CAST(c_nationkey AS VARCHAR) AS ticker, CASE WHEN c_nationkey % 3 = 0 THEN 'other' WHEN c_custkey % 2 = 0 THEN 'business' ELSE 'other' END AS section_type FROM customer), w AS (SELECT * FROM c WHERE section_type = 'business'), o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY id) AS rn FROM c WHERE ticker NOT IN (SELECT ticker FROM w)) SELECT id, ticker FROM w UNION ALL SELECT id, ticker FROM o WHERE rn <= 20")
def relevant_chunks(spark, sf_dir):
    """Risk factors and business of each company, or its first chunks."""
    c = V.table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_nationkey") % 3 == 0, "other").when(F.col("c_custkey") % 2 == 0, "business").otherwise("other")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("chunk_index"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("ticker"), kind.alias("section_type"))
    return service.relevant_chunks(rows).select("id", "ticker")


@query(f"WITH {V.MATCHES} SELECT filing_type, CAST(filing_date AS VARCHAR) AS filing_date, count(*) AS chunks FROM matches WHERE ticker = 'T1' GROUP BY ALL")
def company_filings(spark, sf_dir):
    m = V.matches(spark, sf_dir).withColumn("company_name", F.col("ticker"))
    return service.company_filings(m, "T1").drop("company_name").withColumn("filing_date", F.col("filing_date").cast("string"))


@query(f"WITH {V.MATCHES} SELECT ticker, round(max(similarity), 6) AS best, 'Legislation: L' AS second_line FROM matches GROUP BY ticker")
def impact_texts(spark, sf_dir):
    """The older explanation, line by line."""
    m = V.matches(spark, sf_dir)
    s = m.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("similarity").alias("avg_similarity"), F.max("similarity").alias("max_similarity"))
    x = search.explanation(s.join(search.impact(m), "ticker").withColumn("legislation_id", F.lit("L")))
    return x.select("ticker", _r(F.col("max_similarity")).alias("best"), F.get(F.split("explanation", "\n"), 1).alias("second_line"))
