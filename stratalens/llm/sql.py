"""SQL twins of the subpackage's queries, where SQL can express them."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: str) -> str:
    return f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _address(url: str) -> str:
    return f"CASE WHEN contains({url}, '://') THEN {_host(url)} || CASE WHEN {_path(url)} = '' THEN '/' ELSE {_path(url)} END || regexp_extract({url}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) END"


def _rules(host: str, path: str, rules: list[tuple[str, str, str]], pick: int) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    fits = lambda r: f"({host} = '{r[1]}' OR ends_with({host}, '.{r[1]}')) AND starts_with({path}, '{r[2]}')"
    return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[0] if pick == 0 else r[1] + r[2]}'" for r in ordered) + " END"


def urls(rules: list[tuple[str, str, str]]) -> str:
    tag = lambda name, attribute, value: f"regexp_extract(html, '(?is)<{name}(\\s[^>]*\\s|\\s){attribute}\\s*=\\s*[\"'']?{value}\\b[^>]*>', 0)"
    value = lambda tag_, name: f"regexp_replace(regexp_replace(regexp_extract({tag_}, '(?is)\\s{name}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 0), '(?is)^\\s{name}\\s*=\\s*[\"'']?', ''), '[\"'']$', '')"
    refresh = value(tag("meta", "http-equiv", "refresh"), "content")
    return f"""WITH RECURSIVE p AS (SELECT page_id, url, html, coalesce({_host('url')}, '') AS host, coalesce({_path('url')}, '') AS path, {_address('url')} AS node FROM pages),
l AS (SELECT url, node, host, path, link FROM (SELECT *, {value(tag('link', 'rel', 'canonical'), 'href')} AS link FROM p UNION ALL SELECT *, regexp_replace(regexp_extract({refresh}, '(?is)^[\\s\\d.]*[;,]\\s*url\\s*=\\s*(.*)$', 1), '^[\"'']|[\"'']$', '', 'g') FROM p) WHERE node IS NOT NULL AND link <> ''),
c AS (SELECT *, replace(trim(regexp_replace(link, '[\\t\\r\\n]', '', 'g')), '&amp;', '&') AS t, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site FROM l),
a AS (SELECT node, CASE WHEN regexp_matches(t, '(?i)^https?://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:/?#]*):', 1) || ':' || t WHEN starts_with(t, '/') THEN site || t WHEN starts_with(t, '?') THEN site || path || t
 WHEN t <> '' AND NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:|^#') THEN site || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || t END AS target FROM c),
e AS (SELECT node AS x, {_address('target')} AS y FROM a WHERE target IS NOT NULL),
b AS (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
r(x, y) AS (SELECT x, x FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
v AS (SELECT x, min(y) AS alias_of, max(CAST({_rules(_host("'x://' || y"), _path("'x://' || y"), rules, 0)} = 'allow' AS INTEGER)) AS allow, max(CAST({_rules(_host("'x://' || y"), _path("'x://' || y"), rules, 0)} = 'block' AS INTEGER)) AS block FROM r GROUP BY x)
SELECT page_id, host, path, {_rules('host', 'path', rules, 1)} AS rule, coalesce({_rules('host', 'path', rules, 0)}, CASE WHEN v.allow = 1 THEN 'allow' WHEN v.block = 1 THEN 'block' END, 'allow') AS verdict, v.alias_of FROM p LEFT JOIN v ON p.node = v.x"""


def _lower(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


_WORDS = r"[^\x20\x09-\x0D]+"
_COMPONENTS = """r(x, y) AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT r.x, l.z FROM r JOIN (SELECT a AS y, b AS z FROM links UNION ALL SELECT b, a FROM links) l USING (y)),
least AS (SELECT x, least(x, min(y)) AS part FROM r GROUP BY x)"""


def _similar(num: int) -> str:
    """CTEs: links(a, b) of the sets m(id, token) with 100 * intersection >= num * union. Tokens are ordered by how often
    they occur; sets over the threshold share one among the first |x| - ceil(num% of |x|) + 1 of either."""
    return f"""c AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY often, token) AS place FROM (SELECT token, count(*) AS often FROM m GROUP BY token)),
i AS MATERIALIZED (SELECT id, place FROM m JOIN c USING (token)),
o AS MATERIALIZED (SELECT id, list(place ORDER BY place) AS places FROM i GROUP BY id),
p AS (SELECT id, len(places) AS size, places, unnest(places[1 : len(places) - CAST(ceil({num} * len(places) / 100) AS BIGINT) + 1]) AS place FROM o),
q AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y ON x.place = y.place AND x.id < y.id AND 100 * x.size >= {num} * y.size AND 100 * y.size >= {num} * x.size),
w AS (SELECT a, b, len(x.places) AS n, len(y.places) AS k, len(list_intersect(x.places, y.places)) AS shared FROM q JOIN o x ON x.id = a JOIN o y ON y.id = b),
links AS (SELECT a, b FROM w WHERE 100 * shared >= {num} * (n + k - shared)),
{_COMPONENTS}"""


def neardup(num: int = 85) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS tokens FROM d),
m AS (SELECT doc_id AS id, unnest(tokens) AS token FROM sets),
{_similar(num)}
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_shingles, coalesce(part, doc_id) AS component_id, doc_id = coalesce(part, doc_id) AS kept FROM sets LEFT JOIN least ON x = doc_id"""


def lines() -> str:
    """Numbers distinct lines by their first occurrence, so that the least number of a component is its first line."""
    return f"""WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
l AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line FROM raw WHERE regexp_matches(text, '{_WORDS}')),
f AS (SELECT text, min(struct_pack(doc_id := doc_id, line := line)) AS first FROM l GROUP BY text),
n AS (SELECT text, first, row_number() OVER (ORDER BY first) AS id FROM f),
m AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(2, length(text) - 6)), lambda i: substring({_lower('text')}, i, 8))) AS token FROM n),
{_similar(80)}
SELECT l.doc_id, l.line, b.first.doc_id AS kept_key, b.first.line AS kept_line, l.doc_id = b.first.doc_id AND l.line = b.first.line AS kept
FROM l JOIN n USING (text) LEFT JOIN least ON x = n.id JOIN n b ON b.id = coalesce(part, n.id)"""


def suffixes(size: int = 100) -> str:
    """Texts as hexadecimal digits of their bytes; a byte goes if a string that covers it also starts earlier."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY piece ORDER BY doc_id, pos) AS n FROM (SELECT doc_id, pos, substr(h, CAST(2 * pos + 1 AS INTEGER), {2 * size}) AS piece FROM d, unnest(range(CAST(length(h) / 2 - {size - 1} AS BIGINT))) AS u(pos))),
r AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {size} THEN 0 ELSE 1 END AS fresh FROM s WHERE n > 1),
g AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r),
e AS (SELECT doc_id, run, min(pos) AS low, max(pos) + {size} AS high FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, high AS from_, coalesce(lead(low) OVER (PARTITION BY doc_id ORDER BY low), 9000000000000) AS to_ FROM e UNION ALL SELECT doc_id, 0, min(low) FROM e GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(substr(h, CAST(2 * from_ + 1 AS INTEGER), CAST(2 * (least(to_, length(h) / 2) - from_) AS INTEGER)), '' ORDER BY from_) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(high - low) AS removed, count(*) AS spans FROM e GROUP BY doc_id)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def warc() -> str:
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = lambda shift: f"substr('{digits}', CAST(((v >> {shift}) & 31) + 1 AS INTEGER), 1)"
    base32 = f"array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(sha1(p), CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)), lambda v: {' || '.join(five(s) for s in (15, 10, 5, 0))}), '')"
    return f"""WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages), r AS (SELECT page_id, p, {base32} AS payload_digest, max(page_id) OVER (PARTITION BY p) AS first FROM d)
SELECT page_id, CAST(octet_length(p) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM r"""


def centroids(clusters: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, seed: str = "2") -> str:
    """Rounds of assignment and exact floor means, one after another; integers of 128 bits throughout."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS HUGEINT)) AS q FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), q) - 1 AS k, q FROM v WHERE vec_id IS NOT NULL ORDER BY k LIMIT {clusters})",
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, any_value(vq) AS q, min({{d: d, k: k}}) AS b FROM (SELECT v.n, v.vec_id, v.q AS vq, CAST({far} AS HUGEINT) AS d, c.k FROM v, c{r} c) GROUP BY n)")
        if r < rounds:
            floor = "(s - ((s % m) + m) % m) // m"
            sums = f"SELECT b.k AS k, i, sum(q[i]) AS s, CAST(count(*) AS HUGEINT) AS m FROM a{r}, range(1, {components + 1}) t(i) GROUP BY 1, 2"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(x.q, c.q) AS q FROM c{r} c LEFT JOIN (SELECT k, list(CAST({floor} AS HUGEINT) ORDER BY i) AS q FROM ({sums}) GROUP BY k) x USING (k))")
    digest = "sha256(array_to_string(list_transform(c.q, lambda x: CAST(x AS VARCHAR)), ','))"
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, CAST(a.b.k AS INTEGER) AS cluster, CAST(a.b.d AS BIGINT) AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia, {digest} AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.b.k = c.k"""


_CRC32 = """bytes(i, n, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bytes WHERE n < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS crcs FROM bytes WHERE n = 8)"""


def _crc32(string: str) -> str:
    """CRC-32 of an ASCII string, which DuckDB lacks: by the table of bytes in crc."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({string}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


def conversations() -> str:
    """Turn by turn the least (cost, audit) for each role of the last retained turn, and what that way has written."""
    between = {("e", "s"): "", ("e", "u"): "", ("e", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "u"): "a", ("u", "a"): "", ("a", "u"): "", ("a", "a"): "u"}
    ending = {"e": "", "s": "ua", "u": "a", "a": ""}
    role = {"u": "user", "a": "assistant"}
    line = lambda roles: "".join(f"chr(10) || '{role[r]}:' || " for r in roles)

    def step(to: str) -> str:
        ways = [f"{{c: r.{to}.c + 3, a: r.{to}.a || 'D', t: r.{to}.t}}"]
        for (p, q), missing in between.items():
            if q == to:
                own = f"q.i = '{to}'"
                may = own if to == "s" else "true"
                cost = f"CASE WHEN q.gone OR NOT ({may}) THEN 1000000000 ELSE r.{p}.c + {2 * len(missing)} + q.cut + CASE WHEN {own} THEN 0 ELSE 2 END END"
                ways.append(f"{{c: {cost}, a: r.{p}.a || '{'I' * len(missing)}' || CASE WHEN {own} THEN 'K' ELSE 'R' END, t: r.{p}.t || {line(missing)} chr(10) || CASE WHEN {own} THEN q.role ELSE '{role.get(to, '')}' END || ':' || q.text}}")
        return f"list_min([{', '.join(ways)}]) AS {to}" if len(ways) > 1 else f"{ways[0]} AS {to}"

    none = "{c: 1000000000::BIGINT, a: '', t: ''}"
    last = ", ".join(f"{{c: r.{p}.c + {2 * len(x)}, a: r.{p}.a || '{'I' * len(x)}', t: r.{p}.t || {line(x)} ''}}" for p, x in ending.items())
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE {_CRC32},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k <= 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hit, range(2) c(n) WHERE n < CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
seq AS (SELECT *, left(role, 1) AS i, rtrim(text, {space}) AS trimmed, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j FROM hurt),
old AS (SELECT *, j > min(j) OVER (PARTITION BY conv_id, role, text) AS again FROM seq),
q AS MATERIALIZED (SELECT *, trimmed = '' OR again AS gone, CASE WHEN trimmed != '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut, coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY j) || i NOT IN ('su', 'ua', 'au'), false) AS odd FROM old),
facts AS (SELECT c.conv_id, count(q.j) AS n, coalesce(max(q.turn) - min(q.turn) + 1 - count(DISTINCT q.turn), 0) AS gaps, count(*) FILTER (WHERE q.trimmed = '') AS blank, count(*) FILTER (WHERE q.trimmed != '' AND q.again) AS duplicate, coalesce(sum(q.cut), 0) AS truncated, count(*) FILTER (WHERE q.odd) AS illegal FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN q ON c.conv_id IS NOT DISTINCT FROM q.conv_id GROUP BY c.conv_id),
r(conv_id, j, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{c: 0::BIGINT, a: '', t: ''}}, {none}, {none}, {none} FROM facts
  UNION ALL SELECT r.conv_id, q.j, {step('e')}, {step('s')}, {step('u')}, {step('a')} FROM r JOIN q ON r.conv_id IS NOT DISTINCT FROM q.conv_id AND q.j = r.j + 1),
done AS (SELECT f.*, list_min([{last}]) AS best FROM r JOIN facts f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.j = f.n)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated, CAST(illegal AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256 FROM done"""
