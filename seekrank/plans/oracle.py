"""DuckDB SQL twins of the registered queries (the correctness oracle).

The views ``pages``, ``documents`` and ``embeddings`` are given; every fixture
is re-derived here in SQL, independently of the Spark code. Score literals are
cast to DOUBLE, outputs round scores to 6 decimals, timestamps are rendered as
text and arrays are joined with ``|``.
"""

from __future__ import annotations

from seekrank.config import DEFAULT, GENERIC_MARKERS, STOPWORDS, TEXT_CUT, TEXT_SEARCH_ROWS, WS
from seekrank.plans.fixtures import DIM, NOW, PARAGRAPH_QUERIES

C = DEFAULT


def D(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# --------------------------------------------------------------------------- expressions

def blank(x):
    return f"coalesce({x}, '')"


def ws_trim(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def collapse(x):
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def norm(x):
    return f"trim({collapse(f'regexp_replace(lower({x}), {SEP}, {SPACE}, {G})')})"


SEP = r"'[-_./\\]'"
SPACE = "' '"
G = "'g'"


def strip_tags(x):
    return (f"CASE WHEN contains({x}, '<') AND contains({x}, '>') "
            f"THEN trim({collapse(f'regexp_replace({x}, {chr(39)}<[^>]*>{chr(39)}, {SPACE}, {G})')}) ELSE {x} END")


def title_case(w):
    return f"(upper(substr({w}, 1, 1)) || substr({w}, 2))"


def ts_text(x):
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def stop_list():
    return "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def r6(x):
    return f"round({x}, 6)"


# --------------------------------------------------------------------------- fixtures

def decoded(x):
    """Character references of page text, the ampersand last."""
    for ref, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#34", '"'), ("#39", "''"), ("#x27", "''"), ("apos", "''"),
                      ("nbsp", "\u00a0"), ("copy", "\u00a9"), ("middot", "\u00b7"), ("amp", "&")):
        x = f"replace({x}, '&{ref};', '{char}')"
    return x


def page_body(x):
    """After the opening body tag, up to its closing tag or the end; pages without one: after the head."""
    inside = f"regexp_replace(regexp_extract({x}, '(?is)<body\\b[^>]*>(.*)', 1), '(?is)</body\\s*>.*', '')"
    return f"CASE WHEN regexp_matches({x}, '(?i)<body\\b[^>]*>') THEN {inside} ELSE regexp_replace({x}, '(?is)^.*</head\\s*>', '') END"


def page_title(x, url):
    found = f"regexp_extract({x}, '(?is)<title\\b[^>]*>(.*?)</title', 1)"
    return f"coalesce(nullif(trim({collapse(decoded(found))}), ''), {url})"


def page_text(x):
    bare = f"regexp_replace(({page_body(x)}), '(?s)<!--.*?-->', ' ', 'g')"
    bare = f"regexp_replace({bare}, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', ' ', 'g')"
    return f"trim({collapse(decoded(f'regexp_replace({bare}, {chr(39)}<[^>]*>{chr(39)}, {SPACE}, {G})'))})"


def urls_fx_sql() -> str:
    return f"""SELECT page_id AS id, url,
  regexp_extract(url, '/(de|en|es|fr)/[0-9]', 1) AS type,
  substring({page_title('html', 'url')}, 1, {C.max_title}) AS title,
  substring(txt, 1, {C.max_preview}) AS content_preview,
  coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') AS extracted_content,
  txt AS full_text_content,
  CASE WHEN page_id % 10 = 9 THEN 'pending' WHEN page_id % 10 = 8 THEN 'failed' ELSE 'completed' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (page_id) MINUTE AS created_at,
  TIMESTAMP '{NOW}' - INTERVAL (page_id * 20) MINUTE AS updated_at
FROM (SELECT *, {page_text('html')} AS txt FROM pages)"""


def vectors_fx_sql(src: str = "urls_fx") -> str:
    return f"""SELECT u.id, list_transform(range(0, {DIM}), lambda i: coalesce(m.m[i], 0)::DOUBLE) AS v
FROM {src} u LEFT JOIN (
  SELECT id, map_from_entries(list((b, n))) AS m FROM (
    SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {DIM} AS b, count(*) AS n FROM (
      SELECT id, unnest(string_split_regex(lower(concat(title, chr(10), full_text_content)), '[^a-z0-9]+')) AS tok
      FROM {src}) WHERE length(tok) > 2 GROUP BY 1, 2) GROUP BY id) m ON m.id = u.id"""


def queries_fx_sql() -> str:
    return f"""SELECT page_id + 1 AS query_id,
  CASE page_id % 8 WHEN 0 THEN 'the' WHEN 1 THEN w[1] WHEN 2 THEN concat_ws(' ', w[1], w[2]) WHEN 3 THEN '  zzzz '
    WHEN 4 THEN '' WHEN 5 THEN '---' WHEN 6 THEN 'with that' END AS query,
  CASE page_id % 5 WHEN 0 THEN ['en', 'fr'] WHEN 2 THEN []::VARCHAR[] WHEN 3 THEN [kind] END AS types,
  (CASE page_id % 6 WHEN 0 THEN 20 WHEN 1 THEN 10 WHEN 2 THEN 5 WHEN 4 THEN 0 WHEN 5 THEN 40 END)::BIGINT AS per_page,
  (CASE page_id % 7 WHEN 1 THEN 2 WHEN 2 THEN NULL WHEN 3 THEN 0 WHEN 6 THEN 3 ELSE 1 END)::BIGINT AS page,
  CASE page_id % 9 WHEN 0 THEN 'EXAMPLE.NET' WHEN 1 THEN '  ' WHEN 2 THEN 'fr' END AS type_filter_text,
  CASE WHEN page_id % 11 <> 10 THEN page_id END AS like_id
FROM (SELECT page_id, regexp_extract(url, '/(de|en|es|fr)/[0-9]', 1) AS kind,
  string_split(lower({page_title('html', 'url')}), ' ') AS w FROM pages)"""


def base_ctes() -> list[tuple[str, str]]:
    return [("urls_fx", urls_fx_sql()), ("vectors_fx", vectors_fx_sql()), ("queries_fx", queries_fx_sql())]


def with_ctes(ctes: list[tuple[str, str]], select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS (\n{s}\n)" for n, s in ctes) + "\n" + select


# --------------------------------------------------------------------------- V1, V2

def normalised_queries_sql(src: str = "queries_fx") -> str:
    q = ws_trim("coalesce(query, '')")
    return f"""SELECT query_id,
  CASE WHEN {q} = '' AND coalesce(len(types), 0) > 0 THEN array_to_string(types, ' ') ELSE {q} END AS query,
  types, least(greatest(coalesce(per_page, {C.default_per_page}), 1), {C.max_per_page}) AS per_page,
  greatest(coalesce(page, 1), 1) AS page, type_filter_text, like_id
FROM {src}"""


def budget_sql(src: str) -> str:
    return f"""SELECT *, CASE WHEN query = '' THEN 'query is required' END AS error,
  least({C.max_top_k}, greatest(per_page * page * (CASE WHEN page = 1 THEN {C.first_page_multiplier} ELSE {C.later_page_multiplier} END), per_page * {C.first_page_multiplier}))::BIGINT AS k
FROM {src}"""


# --------------------------------------------------------------------------- V4

def cosine_sql(a, b):
    den = f"nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0)"
    raw = f"(list_dot_product({a}, {b}) / {den})"
    return f"(CASE WHEN {raw} IS NULL OR isnan({raw}) THEN {D(0.0)} ELSE {raw} END)"


def type_ok(types, t):
    return f"({types} IS NULL OR len({types}) = 0 OR coalesce(list_contains({types}, {t}), false))"


def search_ctes() -> list[tuple[str, str]]:
    ctes = base_ctes()
    ctes += [
        ("qn", normalised_queries_sql()),
        ("qk", budget_sql("qn")),
        ("qv", "SELECT qk.*, v.v AS qvec FROM qk LEFT JOIN vectors_fx v ON v.id = qk.like_id"),
        ("qok", "SELECT * FROM qv WHERE error IS NULL AND qvec IS NOT NULL AND len(qvec) > 0"),
        ("corpus", "SELECT v.id, v.v, u.url, u.type, u.title, u.content_preview AS snippet, u.updated_at "
                   "FROM vectors_fx v JOIN urls_fx u ON u.id = v.id WHERE u.status = 'completed'"),
        ("pairs", f"SELECT q.query_id, q.k, c.id, {cosine_sql('c.v', 'q.qvec')} AS score FROM corpus c "
                  f"JOIN qok q ON {type_ok('q.types', 'c.type')}"),
        ("top", "SELECT p.query_id, p.id, p.score, c.url, c.type, c.title, c.snippet, c.updated_at FROM ("
                "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM pairs) p "
                "JOIN corpus c ON c.id = p.id WHERE p.rn <= p.k AND c.url <> ''"),
        ("cand", "SELECT t.*, q.query, q.per_page, q.page, q.type_filter_text FROM top t JOIN qok q USING (query_id)"),
    ]
    ctes += rescore_ctes("cand")
    ctes += rank_ctes("scored")
    ctes += [
        ("totals", "SELECT query_id, count(*) AS total_available FROM ft GROUP BY query_id"),
        ("meta", """SELECT q.query_id, q.page, q.per_page,
  CASE WHEN q.error IS NOT NULL OR q.qvec IS NULL OR len(q.qvec) = 0 THEN 0 ELSE coalesce(t.total_available, 0) END::BIGINT AS total_available,
  (q.error IS NOT NULL OR q.qvec IS NULL OR len(q.qvec) = 0) AS degraded,
  CASE WHEN q.error IS NOT NULL THEN q.error WHEN q.qvec IS NULL OR len(q.qvec) = 0 THEN 'Embedding generation failed: no query vector' END AS reason
FROM qv q LEFT JOIN totals t USING (query_id)"""),
    ]
    ctes += snippet_ctes("page_rows")
    return ctes


# --------------------------------------------------------------------------- R2–R8

def rescore_ctes(src: str) -> list[tuple[str, str]]:
    def has(x):
        return f"(contains({norm(blank(x))}, nq) OR contains(lower({blank(x)}), ql))"

    ls = f"lower({blank('snippet')})"
    lt, lu = f"lower({blank('title')})", f"lower({blank('url')})"
    markers = " OR ".join(f"contains({ls}, '{m}')" for m in GENERIC_MARKERS)
    bare = f"regexp_replace(regexp_replace({lu}, '^https?://', ''), '/\\z', '')"
    generic = (f"({markers} OR length({ls}) < {C.generic_short} OR (length({ls}) < {C.generic_short_no_text} "
               f"AND NOT text_m) OR {lt} = {lu} OR {lt} = {bare})")
    o = "original_score"
    pen = (f"CASE WHEN text_m THEN {o} ELSE CASE WHEN generic THEN {o} * {D(C.penalty_generic)} "
           f"WHEN {o} >= {D(C.high_semantic)} THEN {o} * {D(C.penalty_high)} "
           f"WHEN {o} >= {D(C.min_semantic_no_text)} THEN {o} * {D(C.penalty_mid)} "
           f"ELSE {o} * {D(C.penalty_low)} END END")
    nt = norm(blank("title"))
    exact = f"({nt} = nq OR starts_with({nt}, nq) OR split_part({nt}, ' ', 1) = split_part(nq, ' ', 1))"
    path = f"split_part({lu}, '?', 1)"
    pathm = f"(contains({norm(path)}, nq) OR contains({path}, '/' || ql))"

    def plus(flag, amt):
        return f"(CASE WHEN {flag} THEN {D(amt)} ELSE {D(0.0)} END)"

    hours = f"(date_diff('microsecond', updated_at, TIMESTAMP '{NOW}')::DOUBLE / {D(3.6e9)})"
    rb = (f"CASE WHEN meets AND text_m AND updated_at IS NOT NULL THEN (CASE WHEN {hours} < {D(C.recency_plateau_h)} "
          f"THEN {D(C.recency_max)} WHEN {hours} < {D(C.recency_window_h)} THEN greatest({D(0.0)}, {D(C.recency_max)} * "
          f"({D(1.0)} - {hours} / {D(C.recency_window_h)})) ELSE {D(0.0)} END) ELSE {D(0.0)} END")
    s1 = f"(({pen}) + {plus('title_m', C.boost_title)} + {plus(exact, C.boost_exact)} + {plus('snip_m', C.boost_snippet)})"
    s2 = f"(CASE WHEN url_m THEN {s1} + {D(C.boost_url)} + {plus(pathm, C.boost_url_path)} ELSE {s1} END)"
    strong = f"(meets AND text_m AND {o} > {D(C.strong_semantic)})"
    s3 = f"{s2} + {plus(strong, C.boost_strong)} + recency_boost"
    return [
        ("m0", f"SELECT *, CASE WHEN score IS NULL OR isnan(score) THEN {D(0.0)} ELSE score END AS original_score, "
               f"{norm('query')} AS nq, lower(query) AS ql FROM {src}"),
        ("m1", f"SELECT * EXCLUDE (score), {has('title')} AS title_m, {has('url')} AS url_m, {has('snippet')} AS snip_m FROM m0"),
        ("m2", "SELECT *, (title_m OR url_m OR snip_m) AS text_m FROM m1"),
        ("m3", f"SELECT *, original_score >= CASE WHEN text_m THEN {D(C.min_semantic)} ELSE {D(C.min_semantic_no_text)} END AS meets FROM m2"),
        ("m4", f"SELECT *, {generic} AS generic FROM m3 WHERE meets OR text_m"),
        ("m5", f"SELECT *, {rb} AS recency_boost, {pen} AS pen, {exact} AS exact_m, {pathm} AS path_m FROM m4"),
        ("scored", f"SELECT *, least({s3}, {D(1.0)}) AS score FROM m5"),
    ]


# --------------------------------------------------------------------------- R9–R13

def rank_key():
    return "floor(score * CAST(1000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) DESC, original_score DESC, score DESC, id"


def rank_ctes(src: str) -> list[tuple[str, str]]:
    f = f"lower({ws_trim('coalesce(type_filter_text, ' + chr(39) * 2 + ')')})"
    hit = (f"contains(lower({blank('type')}), {f}) OR contains(lower({blank('url')}), {f}) "
           f"OR contains(lower({blank('title')}), {f})")
    return [
        ("dd", f"SELECT * EXCLUDE (dn) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, "
               f"regexp_replace(lower(url), '/\\z', '') ORDER BY score DESC, original_score DESC, id) AS dn FROM {src}) WHERE dn = 1"),
        ("ft", f"SELECT * FROM dd WHERE {f} = '' OR {hit}"),
        ("pg", f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rank_key()}) AS pos, "
               f"count(*) OVER (PARTITION BY query_id) AS total_available FROM ft"),
        ("page_rows", "SELECT * EXCLUDE (pos), pos - (page - 1) * per_page AS rank FROM pg "
                      "WHERE pos > (page - 1) * per_page AND pos <= page * per_page"),
    ]


# --------------------------------------------------------------------------- T3–T5

def para_ctes(src: str, keys: list[str], content: str, query: str, out: str) -> list[tuple[str, str]]:
    """Best paragraph per key: ``out`` CTE with keys + para."""
    k = ", ".join(keys)
    ws = WS
    p = out
    return [
        (f"{p}_t", f"SELECT {k}, {blank(content)} AS raw, {strip_tags(blank(content))} AS txt, {query} AS q, "
                   f"{norm(query)} AS nq, lower({query}) AS ql FROM {src}"),
        (f"{p}_l", f"SELECT *, list_filter(list_transform(string_split_regex(txt, '\\n{ws}*\\n'), lambda x: {ws_trim('x')}), "
                   f"lambda x: length(x) > {C.min_paragraph}) AS paras, "
                   f"list_filter(string_split_regex(nq, '{ws}+'), lambda w: length(w) > 2) AS words, "
                   f"list_filter(string_split_regex(txt, '[.!?]{ws}+'), lambda s: length({ws_trim('s')}) > {C.min_paragraph}) AS sents "
                   f"FROM {p}_t"),
        (f"{p}_u", f"SELECT {k}, nq, ql, words, unnest(paras) AS para, generate_subscripts(paras, 1) AS pi FROM {p}_l"),
        (f"{p}_s", f"""SELECT {k}, para, pi,
  (CASE WHEN contains({norm('para')}, nq) THEN 100 ELSE 0 END)
  + (CASE WHEN contains(lower(para), ql) THEN 50 ELSE 0 END)
  + coalesce(list_sum(list_transform(words, lambda w: (CASE WHEN contains({norm('para')}, w) THEN 10 ELSE 0 END)
        + (CASE WHEN starts_with({norm('para')}, w) THEN 5 ELSE 0 END))), 0)
  + (CASE WHEN length(para) >= 100 AND length(para) <= 500 THEN 5 WHEN length(para) > 500 THEN 2 ELSE 0 END) AS sc
FROM {p}_u"""),
        (f"{p}_b", f"SELECT {k}, para FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY sc DESC, pi) AS r "
                   f"FROM {p}_s) WHERE r = 1"),
        (out, f"""SELECT l.{k.replace(', ', ', l.')},
  CASE WHEN length({ws_trim('l.raw')}) = 0 THEN ''
       WHEN len(l.paras) > 0 THEN {ws_trim(f'substring(b.para, 1, {C.snippet_chars})')}
       WHEN len(l.sents) > 0 THEN substring(l.sents[1], 1, {C.snippet_chars})
       ELSE substring(l.txt, 1, {C.snippet_chars}) END AS para, l.q
FROM {p}_l l LEFT JOIN {p}_b b USING ({k})"""),
    ]


def phrase_ctes(src: str, keys: list[str], text: str, query: str | None, out: str) -> list[tuple[str, str]]:
    """Top phrases per key: ``out`` CTE with keys + phrases ('|'-joined, '' when none)."""
    k = ", ".join(keys)
    ws = WS
    toks = (f"list_filter(string_split_regex(lower(regexp_replace({blank(text)}, '[^a-zA-Z0-9\\t\\n\\x0B\\f\\r ]', ' ', 'g')), "
            f"'{ws}+'), lambda t: length(t) > 2)")
    qw = (f"list_filter(string_split_regex({norm(query)}, '{ws}+'), lambda w: length(w) > 2)"
          if query else "[]::VARCHAR[]")
    p = out
    sl = stop_list()
    ctes = [
        (f"{p}_k", f"SELECT {k}, {toks} AS toks, {qw} AS qw FROM {src}"),
        (f"{p}_e", f"SELECT {k}, qw, toks, generate_subscripts(toks, 1) AS i FROM {p}_k WHERE len(toks) > 0"),
        (f"{p}_w", f"SELECT {k}, qw, i - 1 AS i0, toks[i] AS w1, CASE WHEN i < len(toks) THEN toks[i + 1] END AS w2 "
                   f"FROM {p}_e WHERE toks[i] NOT IN {sl}"),
        (f"{p}_r", f"""SELECT {k}, w1 AS phrase, {title_case('w1')} AS shown,
  CASE WHEN list_contains(qw, w1) THEN 3 ELSE 1 END AS weight, i0 * 2 AS ord, list_contains(qw, w1) AS has_q FROM {p}_w
UNION ALL
SELECT {k}, w1 || ' ' || w2, {title_case('w1')} || ' ' || {title_case('w2')},
  CASE WHEN list_contains(qw, w1) OR list_contains(qw, w2) THEN 8 ELSE 2 END, i0 * 2 + 1,
  list_contains(qw, w1) OR list_contains(qw, w2) FROM {p}_w WHERE w2 IS NOT NULL AND w2 NOT IN {sl}"""),
        (f"{p}_g", f"SELECT {k}, phrase, sum(weight) AS score, min(ord) AS first, any_value(shown) AS shown, "
                   f"bool_or(has_q) AS has_q FROM {p}_r GROUP BY {k}, phrase"),
        (f"{p}_n", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, first) AS r "
                   f"FROM {p}_g {'WHERE has_q' if query else ''}) WHERE r <= {C.max_phrases}"),
        (out, f"SELECT {k}, string_agg(shown, '|' ORDER BY r) AS phrases FROM {p}_n GROUP BY {k}"),
    ]
    return ctes


def snippet_ctes(src: str) -> list[tuple[str, str]]:
    keys = ["query_id", "id"]
    ctes = [
        ("hy", f"""SELECT r.*, CASE WHEN u.status = 'completed' THEN coalesce(nullif(u.full_text_content, ''),
  nullif(u.extracted_content, ''), '') END AS content FROM {src} r LEFT JOIN urls_fx u ON u.id = r.id"""),
        ("hy_c", "SELECT * FROM hy WHERE coalesce(content, '') <> ''"),
    ]
    ctes += para_ctes("hy_c", keys, "content", "query", "bp")
    ctes += phrase_ctes("bp", keys, "para", "q", "hl")
    ctes += [
        ("hy2", """SELECT h.* EXCLUDE (snippet, content),
  CASE WHEN coalesce(h.content, '') <> '' AND (coalesce(b.para, '') <> '' OR coalesce(l.phrases, '') <> '')
       AND b.para <> '' THEN b.para ELSE h.snippet END AS snippet,
  CASE WHEN coalesce(h.content, '') <> '' AND (coalesce(b.para, '') <> '' OR coalesce(l.phrases, '') <> '')
       THEN coalesce(l.phrases, '') END AS highlights
FROM hy h LEFT JOIN bp b USING (query_id, id) LEFT JOIN hl l USING (query_id, id)"""),
    ]
    ctes += phrase_ctes("hy2", keys, "snippet", None, "tp")
    ctes += [
        ("results", """SELECT h.*, CASE WHEN coalesce(h.highlights, '') <> '' THEN h.highlights ELSE coalesce(t.phrases, '') END AS phrases
FROM hy2 h LEFT JOIN tp t USING (query_id, id)"""),
    ]
    return ctes


# --------------------------------------------------------------------------- matches_fx, paragraphs_fx

def matches_ctes() -> list[tuple[str, str]]:
    ctes = search_ctes()
    ctes = ctes[:[n for n, _ in ctes].index("cand")]
    cols = "type, title, snippet, updated_at"
    ctes += [
        ("matches_fx", f"""SELECT query_id, CAST(id AS VARCHAR) AS id, url, score, {cols} FROM top
UNION ALL SELECT query_id, concat(id, '-copy'), CASE WHEN url LIKE '%/' THEN upper(url) ELSE concat(upper(url), '/') END,
  score + CASE WHEN id % 8 = 0 THEN CAST(-0.003 AS DOUBLE) ELSE CAST(0.003 AS DOUBLE) END, {cols} FROM top WHERE id % 4 = 0"""),
        ("mc", "SELECT m.*, q.query, q.per_page, q.page, q.type_filter_text FROM matches_fx m JOIN qok q USING (query_id)"),
    ]
    return ctes + rescore_ctes("mc")


def paragraphs_ctes() -> list[tuple[str, str]]:
    fixed = " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(PARAGRAPH_QUERIES))
    return [("paragraphs_fx", f"""SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS content,
  CASE doc_id % 4 {fixed} ELSE concat_ws(' ', string_split(lower(text), ' ')[1], string_split(lower(text), ' ')[2]) END AS query
FROM documents""")]


# --------------------------------------------------------------------------- L1–L4

def lexical_ctes() -> list[tuple[str, str]]:
    def pat(x):
        return f"('%' || replace({x}, '\\', '\\\\') || '%')"

    p1, p2 = pat("q.query"), pat("regexp_replace(q.query, '[-_]', ' ', 'g')")

    def il(col, p):
        return f"{col} ILIKE {p} ESCAPE '\\'"

    hit = " OR ".join([il("coalesce(u.title, '')", p1), il("u.url", p1), il("coalesce(u.content_preview, '')", p1),
                       il("coalesce(u.type, '')", p1), il("coalesce(u.title, '')", p2), il("u.url", p2)])
    hours = f"(date_diff('microsecond', updated_at, TIMESTAMP '{NOW}')::DOUBLE / {D(3.6e9)})"
    W = C.text_recency_window_h
    rb = (f"CASE WHEN updated_at IS NOT NULL AND {hours} < {D(W)} THEN greatest({D(0.0)}, {D(C.recency_max)} * "
          f"({D(1.0)} - {hours} / {D(W)})) ELSE {D(0.0)} END")

    def has(c):
        return f"(contains({norm(c)}, nq) OR contains(lower({c}), ql))"

    s = (f"{D(C.text_base)} + (CASE WHEN query <> '' AND {has('title')} THEN {D(C.text_title)} ELSE {D(0.0)} END)"
         f" + (CASE WHEN query <> '' AND {has('url')} THEN {D(C.text_url)} ELSE {D(0.0)} END)"
         f" + (CASE WHEN query <> '' AND {has('snippet')} THEN {D(C.text_snippet)} ELSE {D(0.0)} END)")
    f = f"lower({ws_trim('coalesce(type_filter_text, ' + chr(39) * 2 + ')')})"
    fhit = (f"contains(lower({blank('type')}), {f}) OR contains(lower({blank('url')}), {f}) "
            f"OR contains(lower({blank('title')}), {f})")
    ctes = base_ctes() + [
        ("qn", normalised_queries_sql()),
        ("qk", budget_sql("qn")),
        ("lm", f"""SELECT u.id, u.url, u.type, u.title, u.content_preview, u.status, u.updated_at, q.query_id, q.query
FROM urls_fx u JOIN qk q ON (q.query = '' OR coalesce({hit}, false)) AND {type_ok('q.types', 'u.type')}"""),
        ("lc", "SELECT * FROM lm"),
        ("lcap", f"""SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
  CASE WHEN status = 'completed' THEN 1 WHEN status = 'pending' THEN 2 ELSE 3 END, updated_at DESC NULLS LAST, id) AS r
  FROM lm) WHERE r <= {TEXT_SEARCH_ROWS}"""),
        ("ls0", f"""SELECT id, url, type, CASE WHEN coalesce(title, '') = '' THEN url ELSE title END AS title,
  coalesce(content_preview, '') AS snippet, status, updated_at, query_id, query, {norm('query')} AS nq, lower(query) AS ql FROM lc"""),
        ("ls1", f"SELECT *, {rb} AS recency_boost, {s} AS s0 FROM ls0"),
        ("ls", f"SELECT *, least(s0 + recency_boost, {D(1.0)}) AS score FROM ls1"),
        ("lsc", "SELECT l.*, score - recency_boost AS original_score, q.per_page, q.page, q.type_filter_text FROM ls l JOIN qk q USING (query_id)"),
        ("lft", f"SELECT * FROM lsc WHERE {f} = '' OR {fhit}"),
        ("lpg", f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rank_key()}) AS pos, "
                f"count(*) OVER (PARTITION BY query_id) AS total_available FROM lft"),
        ("lpage", "SELECT * EXCLUDE (pos), pos - (page - 1) * per_page AS rank FROM lpg "
                  "WHERE pos > (page - 1) * per_page AND pos <= page * per_page"),
        ("ltot", "SELECT query_id, count(*) AS total_available FROM lft GROUP BY query_id"),
        ("lmeta", """SELECT q.query_id, q.page, q.per_page, coalesce(t.total_available, 0)::BIGINT AS total_available,
  true AS degraded, 'Using text search (vector search unavailable).' AS reason
FROM qk q LEFT JOIN ltot t USING (query_id)"""),
    ]
    return ctes


# --------------------------------------------------------------------------- uploads

def upload_ctes() -> list[tuple[str, str]]:
    return [
        ("ub", """SELECT page_id, CAST(page_id AS VARCHAR) AS id, concat('upload-', page_id // 100, '.csv') AS upload_id,
  CASE WHEN page_id % 13 = 5 THEN '' ELSE regexp_extract(url, '/(de|en|es|fr)/[0-9]', 1) END AS type,
  CASE WHEN page_id % 17 = 3 THEN '' ELSE url END AS url FROM pages"""),
        ("upload_rows_fx", """SELECT upload_id, page_id * 2 AS row_no, id,
  CASE WHEN page_id % 7 = 2 THEN concat('  ', type, ' ') ELSE type END AS type,
  CASE WHEN page_id % 7 = 2 THEN concat(' ', url, '  ') ELSE url END AS url FROM ub
UNION ALL SELECT upload_id, page_id * 2 + 1, id, 'Again', url FROM ub WHERE page_id % 5 = 0"""),
        ("uclean", f"""SELECT upload_id, row_no, {ws_trim("coalesce(id, '')")} AS id,
  {ws_trim("coalesce(type, '')")} AS type, {ws_trim("coalesce(url, '')")} AS url FROM upload_rows_fx"""),
        ("valid", "SELECT * FROM uclean WHERE length(type) > 0 AND length(url) > 0"),
    ]


def reg_cols(ts=True):
    t = ts_text
    return ("id, url, type, title, content_preview, extracted_content, full_text_content, status, "
            f"{t('created_at')} AS created_at, {t('updated_at')} AS updated_at" if ts else "")


def upsert_sql(reg: str, valid_filter: str, now: str, name: str, src: str = "valid") -> list[tuple[str, str]]:
    inc = f"{name}_inc"
    return [
        (inc, f"SELECT url, arg_min(type, row_no) AS type, min(row_no) AS first_row_no FROM {src} WHERE {valid_filter} GROUP BY url"),
        (f"{name}_kept", f"""SELECT r.id, r.url, r.type, r.title, r.content_preview, r.extracted_content, r.full_text_content,
  CASE WHEN i.url IS NOT NULL THEN 'pending' ELSE r.status END AS status, r.created_at,
  CASE WHEN i.url IS NOT NULL THEN TIMESTAMP '{now}' ELSE r.updated_at END AS updated_at
FROM {reg} r LEFT JOIN {inc} i ON i.url = r.url"""),
        (f"{name}_new", f"""SELECT ((SELECT coalesce(max(id), 0) FROM {reg}) + row_number() OVER (ORDER BY first_row_no, url))::BIGINT AS id,
  url, type, NULL::VARCHAR AS title, NULL::VARCHAR AS content_preview, NULL::VARCHAR AS extracted_content,
  NULL::VARCHAR AS full_text_content, 'pending' AS status, TIMESTAMP '{now}' AS created_at, TIMESTAMP '{now}' AS updated_at
FROM {inc} WHERE url NOT IN (SELECT url FROM {reg})"""),
        (name, f"SELECT * FROM {name}_kept UNION ALL SELECT * FROM {name}_new"),
    ]


def processed_sql() -> str:
    rows = """SELECT u.id, u.url, u.type, u.title, u.content_preview AS preview, u.full_text_content AS text,
  u.extracted_content AS html, CASE WHEN u.id % 11 = 6 THEN NULL ELSE v.v END AS vector,
  CASE WHEN u.id % 11 = 4 THEN 'boom' END AS error
FROM urls_fx u LEFT JOIN vectors_fx v ON v.id = u.id"""
    return f"""WITH r AS ({rows}) SELECT * EXCLUDE (id) FROM r
UNION ALL SELECT * EXCLUDE (id) REPLACE (concat(url, '#gone') AS url) FROM r WHERE id % 17 = 3"""


def index_ctes() -> list[tuple[str, str]]:
    """Trigram lookup of the distinct requests: rarest trigrams per form, candidates, exact matches."""
    def pat(x):
        return f"('%' || replace({x}, '\\', '\\\\') || '%')"

    spaced = "regexp_replace(low, '[-_]', ' ', 'g')"
    fields = ["coalesce(title, '')", "url", "coalesce(content_preview, '')", "coalesce(type, '')"]
    hits = [f"u.{c} ILIKE {pat('q.query')} ESCAPE '\\'" if c == "url" else f"{c.replace('(', '(u.', 1)} ILIKE {pat('q.query')} ESCAPE '\\'" for c in fields]
    spaced_query = "regexp_replace(q.query, '[-_]', ' ', 'g')"
    hits += [f"{c} ILIKE {pat(spaced_query)} ESCAPE '\\'" for c in ("coalesce(u.title, '')", "u.url")]
    grams = "unnest(list_transform(range(1, greatest(1, len({0}) - 1)), lambda i: substr({0}, i, 3)))"
    return base_ctes() + [
        ("qn", normalised_queries_sql()),
        ("iq", "SELECT DISTINCT query, lower(query) AS low FROM qn WHERE len(list_filter(regexp_split_to_array(lower(query), '[%_]+'), lambda p: len(p) >= 3)) > 0"),
        ("ip", f"""SELECT query, 0 AS form, unnest(regexp_split_to_array(low, '[%_]+')) AS piece FROM iq
UNION ALL SELECT query, 1, unnest(string_split({spaced}, '%')) FROM iq WHERE {spaced} <> low"""),
        ("ig", f"SELECT DISTINCT query, form, {grams.format('piece')} AS gram FROM ip"),
        ("it", " UNION ALL ".join(f"SELECT id, lower({c}) AS text FROM urls_fx" for c in fields)),
        ("idg", f"SELECT DISTINCT id, {grams.format('text')} AS gram FROM it"),
        ("idf", "SELECT gram, count(*) AS n FROM idg GROUP BY gram"),
        ("ir", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, form ORDER BY n, gram) AS rn, least(2, count(*) OVER (PARTITION BY query, form)) AS wanted
  FROM (SELECT query, form, gram, coalesce(n, 0) AS n FROM ig LEFT JOIN idf USING (gram))) WHERE rn <= 2"""),
        ("ic", "SELECT DISTINCT query, id FROM (SELECT query, form, id FROM ir JOIN idg USING (gram) GROUP BY query, form, id, wanted HAVING count(*) = wanted)"),
        ("im", f"SELECT q.query, u.id FROM iq q JOIN urls_fx u ON coalesce({' OR '.join(hits)}, false)"),
    ]
