"""DuckDB SQL that gives the rows of the named queries, written apart from them."""

from __future__ import annotations

from ..sources import synthetic
from . import rules


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


HEAD = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):/*([^/?#\s]+)"
BLANK = "[\\s   -     　﻿]"
TRIM = lambda x: f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def parsed(src: str) -> str:
    """``src`` with u_scheme, u_host, u_domain, u_path, u_query, u_valid of its column url."""
    return rf"""
    SELECT *, CASE WHEN u_valid THEN lower(regexp_extract(url, '{HEAD}', 1)) ELSE '' END AS u_scheme,
      CASE WHEN u_valid THEN bare ELSE '' END AS u_host,
      CASE WHEN NOT u_valid THEN '' WHEN len(labels) < 2 THEN bare ELSE labels[-2] || '.' || labels[-1] END AS u_domain,
      CASE WHEN u_valid AND path0 <> '' THEN path0 ELSE '/' END AS u_path,
      CASE WHEN u_valid THEN regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) ELSE '' END AS u_query
    FROM (SELECT *, list_filter(string_split(bare, '.'), lambda x: x <> '') AS labels FROM (
      SELECT *, regexp_replace(host0, '^www\.', '') AS bare, host0 <> '' AND NOT regexp_matches(host0, '[\s<>\[\]^|%\\:]') AS u_valid,
        regexp_extract(rest, '^([^?#]*)', 1) AS path0
      FROM (SELECT *, lower(regexp_replace(regexp_replace(regexp_extract(url, '{HEAD}', 2), '^.*@', ''), ':[0-9]*$', '')) AS host0,
        regexp_replace(url, '{HEAD}', '') AS rest FROM ({src}))))"""


DECODED = lambda x: f"url_decode(replace({x}, '+', ' '))"
FORM = lambda x: f"replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"
NAME, VALUE = DECODED("split_part(p, '=', 1)"), DECODED("CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END")
CLEAN_QUERY = f"array_to_string(list_transform(list_filter(string_split(u_query, '&'), lambda p: p <> '' AND {NAME} NOT IN {_in(rules.TRACKING)}), lambda p: {FORM(NAME)} || '=' || {FORM(VALUE)}), '&')"


def component(x: str) -> str:
    """Percent-encoding that leaves ! ' ( ) * ~ as they are."""
    out = f"url_encode({x})"
    for code, plain in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
        out = f"replace({out}, '{code}', '{plain}')"
    return out


KEY = f"""lower(regexp_replace(CASE WHEN u_valid THEN u_scheme || '://' || u_host || u_path ||
    CASE WHEN {CLEAN_QUERY} <> '' THEN '?' || {CLEAN_QUERY} ELSE '' END ELSE url END, '/$', ''))"""


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN {_in(rules.STOP_WORDS)})"


def intent(q: str) -> str:
    tests = "".join(f" WHEN regexp_matches(lower({q}), '\\b({rules.INTENT_WORDS[i]})\\b') THEN '{i}'" for i in ("discussion", "code", "docs"))
    return f"CASE{tests} WHEN regexp_matches(lower({q}), '^({rules.FACTUAL_START})\\b|\\b({rules.FACTUAL_WORDS})\\b') THEN 'factual' ELSE 'general' END"


def _when(test: str, points: int) -> str:
    return f"CASE WHEN {test} THEN {points} ELSE 0 END"


def _base() -> str:
    doc = f"regexp_matches(u_host, '{rules.DOC_HOST}')"
    has = lambda c, s: f"contains({c}, '{s}')"
    parts = [
        _when(doc, 5),
        _when(f"regexp_matches(u_path, '{rules.SCORED_PATH}')", 4),
        _when(f"regexp_matches(u_host, '{rules.HOSTED_DOCS}')", 4),
        _when(f"u_domain IN {_in(rules.OFFICIAL_DOMAINS)} OR u_host IN {_in(rules.OFFICIAL_DOMAINS)}", 5),
        _when("u_host = 'github.com'", 4),
        _when("ends_with(u_host, '.org')", 1),
        _when(f"u_path = '/' AND NOT {doc}", -2),
        _when(has("u_path", "/search"), -6),
        _when(f"{has('u_path', '/issues')} OR {has('u_path', '/pull/')}", -4),
        _when(has("u_path", "/discussions"), -2),
        _when(has("u_path", "/releases"), 2),
        _when(has("u_path", "/blog"), -2),
        _when(f"regexp_matches(u_host, '{rules.LOW_SIGNAL}')", -5),
        "len(list_filter(toks, lambda t: contains(u_host, t))) * 3",
        "len(list_filter(toks, lambda t: contains(lower(u_path), t))) * 2",
        "len(list_filter(toks, lambda t: contains(hay, t)))",
        _when(has("hay", "official"), 2),
        _when(f"{has('hay', 'documentation')} OR {has('hay', 'docs')}", 3),
        _when(has("hay", "api reference"), 2),
        _when(has("hay", "tutorial"), -1),
        _when(f"{has('hay', 'top ')} OR {has('hay', 'best ')}", -1),
        _when(has("hay", " vs "), -1),
    ]
    return f"CAST(CASE WHEN u_valid THEN {' + '.join(parts)} ELSE 0 END AS INT)"


BASE = _base()
KNOWN = f"(u_host IN {_in(rules.KNOWN_OFFICIAL)} OR u_domain IN {_in(rules.KNOWN_OFFICIAL)})"
OFFICIAL = f"(regexp_matches(u_host, '{rules.DOC_HOST}') OR regexp_matches(u_path, '{rules.OFFICIAL_PATH}') OR u_host IN {_in(rules.REGISTRY_HOSTS)} OR u_domain IN {_in(rules.REGISTRY_HOSTS)} OR {KNOWN})"
CODE, TALK, FACT = (f"(u_domain IN {_in(h)})" for h in (rules.CODE_HOSTS, rules.DISCUSSION_HOSTS, rules.FACTUAL_HOSTS))
ADJUSTMENT = "CAST(CASE intent" + "".join(
    f" WHEN '{i}' THEN " + " + ".join(_when(t, p) for t, p in zip((OFFICIAL, KNOWN, CODE, TALK, FACT), points, strict=True)) for i, points in rules.ADJUSTMENTS.items()
) + " END AS INT)"
CONFIDENT = f"""CASE intent WHEN 'docs' THEN NOT {CODE} AND NOT {TALK} AND NOT {FACT} AND {OFFICIAL} WHEN 'code' THEN {CODE} OR {OFFICIAL} OR score >= 18
    WHEN 'discussion' THEN {TALK} OR score >= 14 WHEN 'factual' THEN {FACT} OR {OFFICIAL} OR score >= 14 ELSE score >= 18 END"""


def _pick(values, index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{index} + 1]"


def _ctes() -> str:
    """dealt (pages of searches), q (searches), hits (rows), s (settle times)."""
    e, n, span = len(rules.ENGINES), synthetic.GROUP, synthetic.SPAN
    return f"""
    dealt AS (SELECT page_id // {n} + k + 1 AS query_id, page_id % {n} + {n} * k AS r, page_id FROM pages, (SELECT range AS k FROM range({span}))),
    q AS (SELECT query_id, {_pick(synthetic.QUERIES, f"((query_id - 1) % {len(synthetic.QUERIES)})")} AS query, 10 AS "limit" FROM (SELECT DISTINCT query_id FROM dealt)),
    qi AS (SELECT *, {intent("query")} AS intent FROM q),
    cells AS (SELECT query_id, r, e, page_id FROM dealt, (SELECT range AS e FROM range({e})) WHERE (r + e * 3 + query_id) % 7 < 1 + r % 6 AND (query_id + e) % 7 <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY (r * 11 + e * 5) % 29, r) - 1 AS pos FROM cells),
    hosted AS (SELECT p.*, html, {_pick(synthetic.HOSTS, f"(p.page_id % {len(synthetic.HOSTS)})")} AS host, {_pick(synthetic.PATHS, f"((p.page_id // 3) % {len(synthetic.PATHS)})")} AS path
      FROM placed p JOIN pages USING (page_id) WHERE pos < {synthetic.HARVEST}),
    hits AS (SELECT query_id, {_pick(rules.ENGINES, "e")} AS engine, CAST((query_id * 389 + e * 613) % 5000 AS INT) AS arrival_ms, CAST(pos AS INT) AS pos,
      regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
      'https://' || host || path || CASE WHEN path = '/' THEN '' ELSE '/p' || page_id END || CASE WHEN e % 3 = 1 THEN '/' ELSE '' END || CASE WHEN e % 2 = 1 THEN '?utm_medium=x' ELSE '' END AS url,
      left(regexp_extract(html, '<p>([^<]*)<', 1), 80 + 20 * e) AS snippet FROM hosted),
    s AS (SELECT query_id, {_pick(rules.ENGINES, "e")} AS engine, CAST((query_id * 389 + e * 613) % 5000 AS INT) AS arrival_ms, (query_id + e) % 7 <> 0 AS ok,
      CASE WHEN (query_id + e) % 7 = 0 THEN 'HTTP 503' END AS error FROM q, (SELECT range AS e FROM range({e})))"""


RANK = "CASE intent" + "".join(f" WHEN '{i}' THEN CAST(coalesce(list_position({list(o)}, engine) - 1, 99) AS INT)" for i, o in rules.ENGINE_ORDER.items()) + " END"
ALLOWED = [e for e in rules.ENGINES if e != "brave"]
ATTEMPTED = "CASE intent" + "".join(f" WHEN '{i}' THEN {[x for x in o if x in ALLOWED]}" for i, o in rules.ENGINE_ORDER.items()) + " END"
SCORED = f"scored AS (SELECT *, {BASE} AS score FROM (SELECT *, {tokens('query')} AS toks, lower(title || ' ' || snippet) AS hay FROM ({parsed('SELECT * FROM hits JOIN qi USING (query_id)')})))"


def _merged(src: str, name: str = "") -> str:
    """CTEs m (groups), capped and ranked of the rows of ``src``."""
    m, u, c, r = (f"{x}{name}" for x in ("m", "mu", "capped", "ranked"))
    decoded = "regexp_replace({0}, '(?i)&#x200B;', '', 'g')"
    for entity, plain in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " ")):
        decoded = f"regexp_replace({decoded}, '(?i)&{entity};', '{plain}', 'g')"
    decoded = TRIM(f"regexp_replace({decoded}, '{BLANK}{{2,}}', ' ', 'g')")
    title, snippet = (decoded.replace("{0}", x).replace("{{2,}}", "{2,}") for x in ("title", "snippet"))
    return f"""
    keyed{name} AS (SELECT *, {KEY} AS dedup_key, {RANK} AS rk, ROW(arrival_ms, {RANK}, pos) AS seq FROM ({parsed(f"SELECT * FROM {src} JOIN qi USING (query_id)")})),
    {m} AS (SELECT query_id, query, "limit", intent, dedup_key, arg_min(title, seq) AS title, arg_min(url, ROW(length(url), seq)) AS url,
      arg_max(snippet, ROW(length(snippet), -arrival_ms, -rk, -pos)) AS snippet, string_agg(engine, '+' ORDER BY seq) AS engines, min(seq) AS first_seq, count(*) AS n_rows
      FROM keyed{name} GROUP BY ALL),
    {u} AS (SELECT *, base + boost + adjustment AS score, u_domain AS domain FROM (SELECT *, {BASE} AS base, CASE WHEN n_rows >= 4 THEN 12 WHEN n_rows = 3 THEN 8 WHEN n_rows = 2 THEN 4 ELSE 0 END AS boost,
      {ADJUSTMENT} AS adjustment FROM (SELECT *, {tokens('query')} AS toks, lower(title || ' ' || snippet) AS hay FROM ({parsed(f"SELECT * FROM {m}")})))),
    {c} AS (SELECT * FROM {u} QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN domain = '' THEN 'unknown' ELSE domain END ORDER BY score DESC, first_seq) <= 2),
    {r} AS (SELECT query_id, left({title}, 120) AS title, url, left({snippet}, 300) AS snippet, CAST(score AS INT) AS score, engines, CAST(rank AS INT) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seq) AS rank FROM {c}) WHERE rank <= "limit")"""


def _profile(field: int) -> str:
    return "CASE intent" + "".join(f" WHEN '{i}' THEN {list(v[field]) if isinstance(v[field], tuple) else v[field]}" for i, v in rules.PROFILES.items()) + " END"


NEVER = 2**31 - 1
FAST = f"""
    sure AS (SELECT DISTINCT query_id, engine FROM (SELECT *, {CONFIDENT} AS c FROM scored WHERE pos < 3) WHERE c),
    n AS (SELECT query_id, engine, count(*) AS n_rows FROM hits GROUP BY ALL),
    t AS (SELECT qi.query_id, intent, arrival_ms, ok, ok AND coalesce(n_rows, 0) > 0 AND list_contains({_profile(2)}, s.engine) AS useful, ok AND sure.engine IS NOT NULL AS sure
      FROM qi JOIN s USING (query_id) LEFT JOIN n USING (query_id, engine) LEFT JOIN sure USING (query_id, engine) {{where}}),
    moments AS (SELECT query_id, intent, settled_all, CAST(ceil(least(settled_all, {_profile(4)}, greatest(
        coalesce(settled[{_profile(0)}], {NEVER}), coalesce(usable[{_profile(1)}], {NEVER}), CASE WHEN {_profile(5)} THEN conf ELSE 0 END, least({_profile(3)}, conf))) / 100.0) * 100 AS INT) AS resolve_ms
      FROM (SELECT query_id, intent, list_sort(list(arrival_ms)) AS settled, list_sort(list(arrival_ms) FILTER (useful)) AS usable,
        coalesce(min(arrival_ms) FILTER (sure), {NEVER}) AS conf, max(arrival_ms) AS settled_all FROM t GROUP BY ALL))"""


def _stats(rows: str) -> str:
    """CTE st: engines by state, of the settlement rows ``rows``."""
    pick = lambda test: f"coalesce(list_filter(attempted, lambda e: list_contains(coalesce({test}, []), e)), [])"
    return f"""
    lists AS (SELECT query_id, list(engine) FILTER (ok) AS yes, list(engine) FILTER (NOT ok) AS no FROM {rows} GROUP BY ALL),
    st AS (SELECT *, list_filter(attempted, lambda e: NOT list_contains(completed, e) AND NOT list_contains(failed, e)) AS pending FROM (
      SELECT query_id, intent, attempted, {pick('yes')} AS completed, {pick('no')} AS failed FROM (SELECT *, {ATTEMPTED} AS attempted FROM qi) LEFT JOIN lists USING (query_id)))"""


ALLOWED_HITS = f"ahits AS (SELECT hits.* FROM hits WHERE engine <> 'brave'), asett AS (SELECT * FROM s WHERE engine <> 'brave')"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
BODY = "regexp_extract(html, '<article>(.*)</article>', 1, 's')"
EVENTS = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
DAY = 86_400_000

REQUESTS = f"""l AS (SELECT event_id, user_id % 8 AS instance, CAST(user_id % 60 AS VARCHAR) AS key, epoch_us(ts) // 1000 AS at_ms, CAST({DAY // 24} AS BIGINT) AS duration,
    row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS n FROM events)"""
#: A step writes the oldest result that has arrived before the next request, or else takes that request.  Entries are in the
#: order of their last use; results arrive in the order of their requests, as all take as long.
CACHED = f"""c AS (
    SELECT DISTINCT instance, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k VARCHAR, t BIGINT)[]) AS kept, CAST([] AS STRUCT(k VARCHAR, t BIGINT)[]) AS flying, CAST(NULL AS VARCHAR) AS outcome FROM l
    UNION ALL SELECT instance, CASE WHEN lands THEN n ELSE n + 1 END,
      CASE WHEN lands THEN list_slice(written, greatest(1, len(written) - 4), len(written)) WHEN fresh THEN list_append(others, list_filter(kept, lambda x: x.k = key)[1]) ELSE others END,
      CASE WHEN lands THEN flying[2:] WHEN fresh OR waits THEN flying ELSE list_append(flying, {{'k': key, 't': at_ms + duration}}) END,
      CASE WHEN lands THEN NULL WHEN fresh THEN 'hit' WHEN waits THEN 'inflight' ELSE 'miss' END
    FROM (SELECT c.instance, c.n, kept, flying, key, at_ms, duration, len(flying) > 0 AND flying[1].t <= at_ms AS lands,
      list_append(list_filter(kept, lambda x: x.k <> flying[1].k AND flying[1].t - x.t <= {2 * DAY}), flying[1]) AS written,
      list_filter(kept, lambda x: x.k <> key) AS others, len(list_filter(kept, lambda x: x.k = key AND at_ms - x.t <= {2 * DAY})) > 0 AS fresh,
      len(list_filter(flying, lambda x: x.k = key)) > 0 AS waits FROM c JOIN l ON l.instance = c.instance AND l.n = c.n + 1)),
  cached AS (SELECT l.*, outcome, CAST(len(kept) AS BIGINT) AS entries FROM c JOIN l USING (instance, n) WHERE outcome IS NOT NULL)"""


def _entities(x: str) -> str:
    out = f"regexp_replace({x}, '(?i)&#x200B;', '', 'g')"
    for entity, plain in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " ")):
        out = f"regexp_replace({out}, '(?i)&{entity};', '{plain}', 'g')"
    return TRIM(f"regexp_replace({out}, '{BLANK}{{2,}}', ' ', 'g')")


def _strip(x: str) -> str:
    return TRIM(f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '{BLANK}+', ' ', 'g')")


def _source(inner: str, engine: str, limit: int, extra: str = "0") -> str:
    """Scored rows of ``inner`` (query_id, query, page_id, title, url, snippet), numbered by page."""
    return f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY page_id) - 1 AS INT) AS pos, title, url, snippet,
      CAST({BASE} + {extra} AS INT) AS score, u_domain AS domain, '{engine}' AS engine
      FROM (SELECT *, {tokens('query')} AS toks, lower(title || ' ' || snippet) AS hay FROM ({parsed(inner)})) QUALIFY pos < {limit}"""


#: The page's entities, and its text: blocks on lines of their own, paragraphs apart.
PLAIN = lambda x: f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
FLAT = lambda x: f"trim(regexp_replace({PLAIN(x)}, '\\s+', ' ', 'g'))"


def _page_text(x: str) -> str:
    out = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    for tags, plain in (("<br>", "chr(10)"), ("</?p>", "chr(10) || chr(10)"), ("</?h1>", "chr(10)"), ("</?b>", "''")):
        out = f"regexp_replace({out}, '{tags}', {plain}, 'g')"
    out = f"regexp_replace(regexp_replace({PLAIN(out)}, ' *\\n *', chr(10), 'g'), ' +', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\n{{2,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


PAGES = f"(SELECT page_id, url, {TITLE} AS title, {BODY} AS body, page_id // 8 AS query_id, 'example docs api' AS query FROM pages)"

ORACLE = {
    "url_parse": f"SELECT page_id, u_scheme AS scheme, u_host AS host, u_domain AS domain, u_path AS path, u_query AS query, u_valid AS valid FROM ({parsed('SELECT * FROM pages')})",
    "url_registrable_domain": f"SELECT page_id, u_domain AS domain FROM ({parsed('SELECT * FROM pages')})",
    "url_dedup_key": f"SELECT page_id, {KEY} AS dedup_key FROM ({parsed('SELECT * FROM pages')})",
    "url_without_params": f"SELECT page_id, {CLEAN_QUERY} AS query FROM ({parsed('SELECT * FROM pages')})",
    "url_unwrap_ddg": "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN url ELSE '' END AS target FROM pages",
    "url_unwrap_bing": "SELECT page_id, url AS target FROM pages",
    "url_search_request": f"WITH {_ctes()} SELECT query_id, 'https://search.example.com/?q=' || replace(query, ' ', '+') || '&source=web' AS request, {component('query')} AS component FROM q",
    "text_decode_entities": f"SELECT page_id, {_entities(f'''{TITLE} || ' &amp;lt; &nbsp; &QUOT; ' || {BODY}''')} AS decoded FROM pages",
    "text_strip_html": f"SELECT page_id, {_strip(BODY)} AS stripped FROM pages",
    "text_keyword_tokens": f"SELECT conv_id, turn, array_to_string({tokens('text')}, '+') AS tokens FROM conversations",
    "text_overlap": f"""SELECT page_id, CAST(len(list_filter({tokens(f"regexp_replace({TITLE}, '[^A-Za-z ]', ' ', 'g')")}, lambda t: contains(lower({BODY}), t))) * 2 AS INT) AS score FROM pages""",
    "text_truncate": "SELECT doc_id, left(text, 120) AS cut FROM documents",
    "text_word_count": f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda w: w <> '')) AS n_words FROM documents",
    "text_normalise_content": f"SELECT doc_id, sha256(left({TRIM("regexp_replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")}, 5000)) AS content_sha256 FROM documents",
    "cache_keys": f"""WITH {_ctes()} SELECT query_id, lower(query) || '|' || CASE WHEN query_id % 2 = 0 THEN 'bing,google' ELSE 'all' END || '|10' AS cache_key FROM q""",
    "intent": f"WITH {_ctes()} SELECT query_id, intent FROM qi",
    "intent_of_texts": f"SELECT {intent('text')} AS intent, count(*) AS n FROM conversations GROUP BY ALL",
    "score_base": f"WITH {_ctes()}, {SCORED} SELECT query_id, engine, pos, score FROM scored",
    "score_intent_adjustment": f"WITH {_ctes()}, {SCORED} SELECT query_id, engine, pos, {ADJUSTMENT} AS adjustment FROM scored",
    "score_predicates": f"WITH {_ctes()}, {SCORED} SELECT query_id, engine, pos, {OFFICIAL} AS officialish, {KNOWN} AS known, {CONFIDENT} AS confident FROM scored",
    "score_star_bonus": "SELECT o_orderkey, CAST(CASE WHEN floor(o_totalprice) > 0 THEN least(floor(log10(floor(o_totalprice) + 1)), 5) ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN -3 ELSE 0 END AS INT) AS extra FROM orders",
    "serp_hits": f"WITH {_ctes()} SELECT * FROM hits",
    "serp_union": f"WITH {_ctes()} SELECT engine, count(*) AS n FROM hits GROUP BY ALL",
    "serp_first_seen": f"SELECT u_domain AS domain, min(page_id) AS page_id FROM ({parsed('SELECT * FROM pages')}) GROUP BY ALL",
    "serp_engine_limit": f"WITH {_ctes()} SELECT query_id, engine, pos, url FROM hits WHERE pos < 5 AND title <> '' AND url <> ''",
    "engine_ranks": f"WITH {_ctes()} SELECT DISTINCT query_id, engine, {RANK} AS rank FROM hits JOIN qi USING (query_id)",
    "engines_attempted": f"""WITH {_ctes()} SELECT query_id, array_to_string(list_filter({ATTEMPTED}, lambda e: query_id % 3 <> 0 OR e IN ('github', 'brave', 'bing', 'nowhere')), '+') AS attempted FROM qi""",
    "merged_groups": f"WITH {_ctes()}, {_merged('hits')} SELECT query_id, dedup_key, title, url, snippet, engines, base, boost, adjustment, CAST(score AS INT) AS score, domain, n_rows FROM mu",
    "domain_cap": f"WITH {_ctes()}, {_merged('hits')} SELECT query_id, dedup_key, CAST(score AS INT) AS score FROM capped",
    "ranked_results": f"WITH {_ctes()}, {_merged('hits')} SELECT * FROM ranked",
    "selected_fields": f"WITH {_ctes()}, {_merged('hits')} SELECT query_id, url, rank FROM ranked",
    "response_envelopes": f"WITH {_ctes()}, {_merged('hits')} SELECT query_id, query, CAST(count(rank) AS INT) AS total, string_agg(url, '+' ORDER BY rank) AS urls FROM q LEFT JOIN ranked USING (query_id) GROUP BY ALL",
    "documents_per_source": "SELECT doc_id, source AS domain, n_chars AS score FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 2",
    "engine_counts": f"WITH {_ctes()} SELECT query_id, engine, count(*) AS n FROM hits GROUP BY ALL",
    "engine_statistics": f"""WITH {_ctes()}, {_stats('s')} SELECT query_id, intent, array_to_string(attempted, '+') AS attempted, array_to_string(completed, '+') AS completed, array_to_string(failed, '+') AS failed,
      array_to_string(pending, '+') AS pending, CAST((SELECT count(*) FROM hits h WHERE h.query_id = st.query_id AND list_contains(completed, engine)) AS INT) AS n_rows, CAST(len(failed) AS INT) AS n_errors,
      len(failed) + len(pending) > 0 AS partial FROM st""",
    "settlement_timeouts": f"""WITH {_ctes()}, l AS (SELECT *, CASE WHEN engine IN {_in(rules.API_ENGINES)} THEN 3000 ELSE 4000 END AS most FROM s)
      SELECT query_id, engine, least(arrival_ms, most) AS arrival_ms, ok AND arrival_ms <= most AS ok, CASE WHEN arrival_ms > most THEN 'timeout after ' || most || ' ms' ELSE error END AS error FROM l""",
    "fast_path": f"WITH {_ctes()}, {SCORED}, {FAST.replace('{where}', '')} SELECT * FROM moments",
    "search_answers": f"""WITH {_ctes()}, {SCORED}, {FAST.replace('{where}', "WHERE s.engine <> 'brave'")}, {ALLOWED_HITS},
      fhits AS (SELECT ahits.* FROM ahits JOIN moments USING (query_id) WHERE arrival_ms <= resolve_ms), fsett AS (SELECT asett.* FROM asett JOIN moments USING (query_id) WHERE arrival_ms <= resolve_ms),
      {_merged('fhits', '1')}, {_merged('ahits', '2')}, {_stats('fsett')}
      SELECT query_id, 'fast' AS phase, CAST(count(rank) AS INT) AS total, any_value(len(failed) + len(pending) > 0) AS partial, resolve_ms AS elapsed_ms, moments.intent, array_to_string(pending, '+') AS pending, coalesce(string_agg(url, '+' ORDER BY rank), '') AS urls
      FROM moments JOIN st USING (query_id) LEFT JOIN ranked1 USING (query_id) GROUP BY query_id, resolve_ms, moments.intent, pending
      UNION ALL SELECT query_id, 'final', CAST(count(rank) AS INT), (SELECT count(*) > 0 FROM asett a WHERE a.query_id = moments.query_id AND NOT ok), greatest(resolve_ms, settled_all), intent, '', coalesce(string_agg(url, '+' ORDER BY rank), '')
      FROM moments LEFT JOIN ranked2 USING (query_id) WHERE settled_all > resolve_ms GROUP BY query_id, resolve_ms, settled_all, intent""",
    "search_answers_final": f"""WITH {_ctes()}, {SCORED}, {FAST.replace('{where}', "WHERE s.engine <> 'brave'")}, {ALLOWED_HITS}, {_merged('ahits')}, {_stats('asett')}
      SELECT query_id, 'final' AS phase, CAST(count(rank) AS INT) AS total, any_value(len(failed) + len(pending) > 0) AS partial, greatest(resolve_ms, settled_all) AS elapsed_ms, moments.intent, array_to_string(failed, '+') AS failed
      FROM moments JOIN st USING (query_id) LEFT JOIN ranked USING (query_id) GROUP BY query_id, resolve_ms, settled_all, moments.intent, failed""",
    "request_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY ALL",
    "last_seen": f"WITH {EVENTS} SELECT event_type, arg_max(event_id, ROW(at_ms, event_id)) AS last_event_id, arg_max(user_id, ROW(at_ms, event_id)) AS last_user_id, max(at_ms) AS last_at_ms FROM e GROUP BY ALL",
    "last_failures": f"WITH {_ctes()} SELECT engine, arg_max(error || ' in ' || query_id, query_id) AS error, count(*) AS n FROM s WHERE NOT ok GROUP BY ALL",
    "conversation_last_turn": "SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS last_turn FROM conversations GROUP BY ALL",
    "rate_limit": f"""WITH RECURSIVE {EVENTS}, r AS (SELECT event_id, user_id, at_ms, n, true AS accepted, [at_ms] AS log FROM e WHERE n = 1
      UNION ALL SELECT event_id, user_id, at_ms, n, len(f) < 3, CASE WHEN len(f) < 3 THEN list_append(f, at_ms) ELSE f END
      FROM (SELECT e.*, list_filter(r.log, lambda x: x >= e.at_ms - {3 * DAY}) AS f FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
      SELECT event_id, user_id, at_ms, accepted FROM r""",
    "cool_down": f"""WITH RECURSIVE {EVENTS}, r AS (SELECT event_id, user_id, at_ms, n, event_type = 'error' AS challenged, CASE WHEN event_type = 'error' THEN 'challenged' ELSE 'ok' END AS outcome,
      CASE WHEN event_type = 'error' THEN at_ms + {2 * DAY} ELSE 0 END AS until FROM e WHERE n = 1
      UNION ALL SELECT e.event_id, e.user_id, e.at_ms, e.n, e.event_type = 'error', CASE WHEN e.at_ms < until THEN 'blocked' WHEN e.event_type = 'error' THEN 'challenged' ELSE 'ok' END,
      CASE WHEN e.at_ms >= until AND e.event_type = 'error' THEN e.at_ms + {2 * DAY} ELSE until END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
      SELECT event_id, user_id, at_ms, challenged, outcome FROM r""",
    "single_flight": f"""WITH RECURSIVE {EVENTS}, r AS (SELECT event_id, user_id, at_ms, n, true AS leader, event_id AS leader_id, at_ms + {DAY} AS until FROM e WHERE n = 1
      UNION ALL SELECT e.event_id, e.user_id, e.at_ms, e.n, e.at_ms >= until, CASE WHEN e.at_ms >= until THEN e.event_id ELSE leader_id END, CASE WHEN e.at_ms >= until THEN e.at_ms + {DAY} ELSE until END
      FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
      SELECT event_id, user_id, at_ms, {DAY} AS duration, leader, leader_id FROM r""",
    "slot_queue": f"""WITH RECURSIVE {REQUESTS}, r AS (SELECT *, at_ms AS start, [at_ms + duration, 0] AS free FROM l WHERE n = 1
      UNION ALL SELECT l.*, greatest(l.at_ms, list_min(free)), [list_max(free), greatest(l.at_ms, list_min(free)) + l.duration] FROM r JOIN l ON l.instance = r.instance AND l.n = r.n + 1)
      SELECT event_id, instance, at_ms, duration, start, start - at_ms AS waited FROM r""",
    "result_cache": f"WITH RECURSIVE {REQUESTS}, {CACHED} SELECT event_id, instance, key, at_ms, duration, outcome, entries FROM cached",
    "result_cache_stats": f"""WITH RECURSIVE {REQUESTS}, {CACHED} SELECT instance, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome <> 'hit') AS misses,
      count(*) FILTER (outcome = 'inflight') AS inflight_hits, count(*) FILTER (outcome = 'miss') AS writes FROM cached GROUP BY ALL""",
    "source_reddit": _source(
        f"""SELECT query_id, query, page_id, title, CASE WHEN page_id % 2 = 1 THEN 'https://www.reddit.com/r/x/' || page_id ELSE link END AS url,
        left(CASE WHEN page_id % 5 <> 0 AND body <> '' THEN left(body, 200) ELSE 'r/x · ' || page_id || ' points' END, 300) AS snippet
        FROM (SELECT *, CASE WHEN page_id % 4 = 0 AND starts_with(url, 'http') THEN url ELSE 'https://www.reddit.com/r/x/' || page_id END AS link FROM {PAGES})
        QUALIFY row_number() OVER (PARTITION BY query_id, link ORDER BY page_id) = 1""",
        "reddit",
        6,
    ),
    "source_github": _source(
        f"""SELECT query_id, query, page_id, CASE WHEN page_id % 2 = 0 AND title <> '' THEN title ELSE 'name' END AS title, url,
        left(CASE WHEN page_id % 3 = 0 AND body <> '' THEN body || ' · ' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN 'Topics: search, api · ' ELSE '' END || '★ ' || page_id * 37, 300) AS snippet
        FROM {PAGES} WHERE page_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY page_id) = 1""",
        "github",
        6,
        "CASE WHEN page_id % 4 = 0 THEN -3 ELSE 0 END + CASE WHEN page_id > 0 THEN least(floor(log10(page_id * 37 + 1)), 5) ELSE 0 END",
    ),
    "source_wikipedia": _source(
        f"""SELECT query_id, query, page_id, title, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://en.wikipedia.org/wiki/' || {component('title')} END AS url, left({_strip('extract')}, 300) AS snippet
        FROM (SELECT *, CASE WHEN page_id % 6 = 0 THEN title || ' may refer to: ' || CASE WHEN page_id % 4 = 0 THEN body ELSE '' END ELSE body END AS extract FROM {PAGES})
        WHERE page_id % 7 <> 0 AND page_id % 5 <> 0 AND page_id % 9 <> 0 AND NOT (contains(lower(extract), 'may refer to:') AND length(extract) < 500)""",
        "wikipedia",
        5,
    ),
    "source_brave": _source(f"SELECT query_id, query, page_id, title, url, left(body, 300) AS snippet FROM {PAGES} WHERE page_id % 5 <> 0 AND title <> ''", "brave", 6),
    "extracted_pages": f"""SELECT page_id, url, title, content, CAST(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS INT) AS word_count
      FROM (SELECT page_id, url, {FLAT(TITLE)} AS title, left({_page_text(BODY)}, 50000) AS content FROM pages)""",
    "source_search_pages": _source(
        f"""SELECT query_id, query, page_id, {FLAT('title')} AS title, url, left({FLAT("regexp_replace(body, '<[^>]*>', ' ', 'g')")}, 300) AS snippet
        FROM (SELECT * FROM {PAGES} WHERE starts_with(url, 'http') QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY page_id) = 1) WHERE {FLAT('title')} <> ''""",
        "bing",
        6,
    ),
    "source_shape_errors": """SELECT page_id, engine, CASE WHEN page_id % 5 = 0 AND engine = 'github' THEN 'GitHub API: rate limited (403)'
      WHEN page_id % 5 IN (0, 2) AND engine = 'brave' THEN 'Brave API: authentication failed (' || [403, 500, 401][page_id % 5 + 1] || ')' WHEN page_id % 5 < 3 THEN name || ' API: HTTP ' || [403, 500, 401][page_id % 5 + 1]
      WHEN page_id % 3 <> 0 AND engine <> 'wikipedia' THEN name || ' API: unexpected response shape' END AS error
      FROM pages, (VALUES ('github', 'GitHub'), ('reddit', 'Reddit'), ('brave', 'Brave'), ('wikipedia', 'Wikipedia')) t(engine, name)""",
}
