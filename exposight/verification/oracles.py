"""DuckDB SQL for every registered query, written apart from the Spark code.

Texts between braces are the input views of ``views.py``; everything else is the
plain SQL reading of what an operator means.
"""

from __future__ import annotations

from exposight.functions import fixed_values as fv
from exposight.verification.views import duckdb_sql

_NL = "chr(10)"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quote(v) for v in values) + "]"


# --- text and html -------------------------------------------------------------

# White space of both engines: RE2 knows ASCII only, so the Unicode ones are listed.
_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _decode(x: str) -> str:
    table = [("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&quot;", "chr(34)"), ("&lt;", "chr(60)"),
             ("&gt;", "chr(62)"), ("&nbsp;", "chr(160)"), ("&amp;", "chr(38)")]
    for name, char in table:
        x = f"replace({x}, '{name}', {char})"
    return x


def _drop(x: str, tags=fv.NON_TEXT_TAGS) -> str:
    for tag in tags:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b.*?(?:</{tag}\s*>|\z)', chr(1), 'g')"
    return x


_A_TAG = r"""(?s)<!--.*?-->|<[/!A-Za-z](?:[^>="]|="[^"]*"|=)*>"""


def _nodes(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '{_A_TAG}', chr(1), 'g'), chr(1))"


def _joined(x: str, separator: str) -> str:
    cleaned = f"list_transform({_nodes(x)}, lambda n: {_strip(_decode('n'))})"
    return f"array_to_string(list_filter({cleaned}, lambda n: n <> ''), '{separator}')"


def _mail_markup(x: str) -> str:
    unwrapped = rf"regexp_replace({x}, '<([\w.-]+@[\w.-]+\.\w+)>', '\1', 'g')"
    kept = f"list_transform(list_filter({_nodes(unwrapped)}, lambda n: n <> ''), lambda n: {_decode('n')})"
    return f"array_to_string({kept}, ' ')"


def _no_zero_width(x: str) -> str:
    return rf"regexp_replace({x}, '[\x{{200B}}-\x{{200F}}\x{{FEFF}}]', '', 'g')"


def _clean_subject(x: str) -> str:
    return _strip(_no_zero_width(_mail_markup(f"coalesce({x}, '')")))


def _clean_body(x: str) -> str:
    inner = _no_zero_width(_mail_markup(f"coalesce({x}, '')"))
    return _strip(f"regexp_replace({inner}, '{_WS}+', ' ', 'g')")


_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_PHONE = r"(?:\+44\s?|\(?0\d{2,4}\)?[\s.-]?)\d{3,4}[\s.-]?\d{3,4}"

# --- urls ----------------------------------------------------------------------

_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"


def _canonical(x: str) -> str:
    scheme = f"lower(regexp_extract({x}, '{_SCHEME}', 1))"
    netloc = f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    path = f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"{scheme} || '://' || {netloc} || regexp_replace({path}, ';[^/]*$', '')"


def _resolve(base: str, href: str) -> str:
    """Enough of URL resolution for the links that occur: at most one leading ``../``."""
    origin = f"regexp_extract({base}, '^[a-z]+://[^/?#]*')"
    path = f"regexp_extract({base}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    folder = f"(CASE WHEN {path} = '' THEN '/' ELSE regexp_replace({path}, '[^/]*$', '') END)"
    query = rf"regexp_extract({base}, '^[^?#]*(\?[^#]*)', 1)"
    return f"""CASE WHEN {href} = '' THEN {base}
      WHEN regexp_matches({href}, '{_SCHEME}') THEN {href}
      WHEN {href} LIKE '//%' THEN regexp_extract({base}, '^[a-z]+:') || {href}
      WHEN {href} LIKE '/%' THEN {origin} || {href}
      WHEN {href} LIKE '?%' THEN {origin} || {path} || {href}
      WHEN {href} LIKE '#%' THEN {origin} || {path} || {query} || {href}
      WHEN {href} LIKE '../%' THEN {origin} || (CASE WHEN {folder} = '/' THEN '/' ELSE regexp_replace({folder}, '[^/]*/$', '') END) || substr({href}, 4)
      ELSE {origin} || {folder} || {href} END"""


_UNQUOTE = "substr(v, 2, length(v) - 2)"

# Pages taken apart once: page_id, url, markup, text, links.
_PAGES = rf"""
marked AS (SELECT page_id, url, html, {_drop('html')} AS dropped FROM {{raw_pages}}),
cleared AS (SELECT *, regexp_replace(dropped, '(?s)<!--.*?-->', chr(1), 'g') AS markup, {_joined(_drop('dropped', fv.HIDDEN_TEXT_TAGS), ' ')} AS extracted_text FROM marked),
anchors AS (
  SELECT page_id, url, unnest(range(1, len(hrefs) + 1)) AS pos, unnest(hrefs) AS v, unnest(inners) AS inner_html FROM (
    SELECT page_id, url,
      regexp_extract_all(markup, '(?is)<a\s[^>]*?href\s*=\s*("[^"]*")[^>]*>(.*?)</a', 1) AS hrefs,
      regexp_extract_all(markup, '(?is)<a\s[^>]*?href\s*=\s*("[^"]*")[^>]*>(.*?)</a', 2) AS inners
    FROM cleared)),
hrefs AS (SELECT page_id, url, pos, {_decode(_UNQUOTE)} AS href, lower({_joined('inner_html', '')}) AS label FROM anchors),
links AS (SELECT page_id, pos, label, href, {_resolve('url', 'href')} AS resolved FROM hrefs),
images AS (
  SELECT DISTINCT page_id, first_pos, image_url FROM (
    SELECT page_id, {_resolve('url', 'src')} AS image_url, min(pos) AS first_pos FROM (
      SELECT page_id, url, pos, {_decode(_UNQUOTE)} AS src FROM (
        SELECT page_id, url, unnest(range(1, len(srcs) + 1)) AS pos, unnest(srcs) AS v FROM (
          SELECT page_id, url, regexp_extract_all(markup, '(?is)<img\b(?:[^>="]|="[^"]*")*?\ssrc\s*=\s*("[^"]*")', 1) AS srcs FROM cleared)))
    GROUP BY ALL)),
emails AS (
  SELECT page_id, email, min(pos) AS first_pos FROM (
    SELECT page_id, unnest(found) AS email, unnest(range(1, len(found) + 1)) AS pos FROM (
      SELECT page_id, regexp_extract_all(extracted_text, '{_EMAIL}') AS found FROM cleared)
    UNION ALL
    SELECT page_id, replace(resolved, 'mailto:', ''), 1000000 + pos FROM links WHERE resolved LIKE 'mailto:%')
  GROUP BY page_id, email),
phones AS (
  SELECT page_id, phone_number, min(pos) AS first_pos FROM (
    SELECT page_id, unnest(found) AS phone_number, unnest(range(1, len(found) + 1)) AS pos FROM (
      SELECT page_id, regexp_extract_all(extracted_text, '{_PHONE}') AS found FROM cleared))
  GROUP BY page_id, phone_number),
typed AS (
  SELECT page_id, resolved AS url, link_type, min(pos) AS first_pos FROM (
    SELECT page_id, pos, resolved, 'contact' AS link_type FROM links WHERE resolved NOT LIKE 'mailto:%' AND contains(label, 'contact')
    UNION ALL SELECT page_id, pos, resolved, 'privacy' FROM links WHERE resolved NOT LIKE 'mailto:%' AND contains(label, 'privacy')
    UNION ALL SELECT page_id, pos, resolved, 'social' FROM links WHERE resolved NOT LIKE 'mailto:%'
      AND ({" OR ".join(f"contains(resolved, '{s}')" for s in fv.SOCIAL_LINK_DOMAINS)}))
  GROUP BY page_id, resolved, link_type),
meta AS (
  SELECT page_id,
    array_to_string(list_filter(list_transform({_nodes("regexp_extract(dropped, '(?is)<title[^>]*>(.*?)</title', 1)")}, lambda n: {_strip(_decode('n'))}), lambda n: n <> ''), '') AS page_title,
    {_decode("regexp_extract(html, '<meta name=.description. content=.([^>]*).>', 1)")} AS description,
    {_decode("regexp_extract(html, '<meta content=.([^>]*). name=.keywords.>', 1)")} AS keywords
  FROM cleared)
"""


def _pages(select: str) -> str:
    return f"WITH {_PAGES} {select}"


# --- identity ------------------------------------------------------------------

_SUBJECTS = """
subject AS (
  SELECT subject_id, first_name, last_name, email,
    from_json(middle_names, '["VARCHAR"]') AS mids, from_json(usernames, '["VARCHAR"]') AS users,
    coalesce(from_json(locations, '["VARCHAR"]'), []) AS places, from_json(numbers, '["VARCHAR"]') AS phones
  FROM {subjects})
"""

_TERMS = (
    _SUBJECTS
    + """,
terms AS (
  SELECT DISTINCT * FROM (
    SELECT subject_id, 'email' AS entity_type, email AS entity_value, CAST(1.0 AS DOUBLE) AS confidence FROM subject WHERE email IS NOT NULL
    UNION ALL SELECT subject_id, 'username', unnest(users), 1.0 FROM subject
    UNION ALL SELECT subject_id, 'location', unnest(places), 0.8 FROM subject
    UNION ALL SELECT subject_id, 'phone', unnest(list_filter(phones, lambda p: regexp_matches(p, '[0-9]'))), 1.0 FROM subject
    UNION ALL SELECT subject_id, 'name', first_name || ' ' || last_name, 1.0 FROM subject
    UNION ALL SELECT subject_id, 'name', first_name || ' ' || array_to_string(mids, ' ') || ' ' || last_name, 1.0 FROM subject WHERE len(mids) > 0
    UNION ALL SELECT subject_id, 'name', unnest(list_transform(mids, lambda m: first_name || ' ' || m || ' ' || last_name)), 1.0 FROM subject))
"""
)

_TOKEN_DIGITS = (
    "array_to_string(list_transform(regexp_extract_all(extracted_text, '[+(]?[0-9][0-9\\s().-]*'), "
    "lambda r: regexp_replace(r, '[^0-9]', '', 'g')), ' ')"
)

_FOUND = (
    _TERMS
    + f""",
pages_text AS MATERIALIZED (
  SELECT page_id, lower(extracted_text) AS lowered, regexp_replace(extracted_text, '[^0-9]', '', 'g') AS all_digits,
    {_TOKEN_DIGITS} AS token_digits
  FROM {{page_texts}} WHERE extracted_text IS NOT NULL),
needles AS MATERIALIZED (
  SELECT *, CASE WHEN entity_type = 'phone' THEN regexp_replace(entity_value, '[^0-9]', '', 'g') ELSE lower(entity_value) END AS needle FROM terms),
found AS MATERIALIZED (
  SELECT n.subject_id, p.page_id, n.entity_type, n.entity_value, n.confidence FROM pages_text p, needles n
  WHERE n.entity_type <> 'phone' AND contains(p.lowered, n.needle)
  UNION ALL
  SELECT n.subject_id, p.page_id, n.entity_type, n.entity_value, n.confidence FROM pages_text p, needles n
  WHERE n.entity_type = 'phone' AND contains(p.all_digits, n.needle)),
scores AS (
  SELECT page_id, subject_id, count(*) AS n_findings,
    CAST(sum(CASE entity_type WHEN 'email' THEN 25 WHEN 'phone' THEN 40 ELSE 0 END) AS BIGINT) AS risk_score
  FROM found GROUP BY page_id, subject_id)
"""
)


def _risk(where: str) -> str:
    return f"""WITH {_FOUND}
SELECT p.page_id, s.subject_id, coalesce(s.n_findings, 0) AS n_findings, coalesce(s.risk_score, 0) AS risk_score
FROM {{page_texts}} p LEFT JOIN scores s ON s.page_id = p.page_id {where}"""


_NAMES = (
    _SUBJECTS
    + """,
masks AS (SELECT subject_id, first_name, last_name, mids, unnest(range(0, CAST(power(2, len(mids)) AS BIGINT))) AS mask FROM subject),
names AS (
  SELECT DISTINCT subject_id, concat_ws(' ', first_name,
    CASE WHEN mask = 0 THEN NULL ELSE array_to_string(list_filter(mids, lambda m: (mask >> (list_position(mids, m) - 1)) & 1 = 1), ' ') END, last_name) AS name
  FROM masks),
ordered AS (SELECT subject_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY name) - 1 AS INT) AS name_ord, name FROM names)
"""
)

_SITES = _list("site:" + s for s in fv.SOCIAL_SITES + fv.DEV_SITES + fv.LEAK_SITES)

_QUERIES = (
    _NAMES
    + f""",
raw_queries AS (
  SELECT subject_id, 1 AS family, 0 AS a, pos AS b, '"' || email || '"' || suffix AS q
    FROM subject, (SELECT unnest(['', ' leak', ' breach', ' password']) AS suffix, unnest(range(4)) AS pos) WHERE email IS NOT NULL
  UNION ALL SELECT subject_id, 2, a, pos, '"' || number || '"' || suffix
    FROM (SELECT subject_id, unnest(phones) AS number, unnest(range(len(phones))) AS a FROM subject), (SELECT unnest(['', ' leak', ' pastebin']) AS suffix, unnest(range(3)) AS pos)
  UNION ALL SELECT subject_id, 3, a, pos, '"' || username || '"' || suffix
    FROM (SELECT subject_id, unnest(users) AS username, unnest(range(len(users))) AS a FROM subject),
         (SELECT unnest(list_concat([''], list_transform({_SITES}, lambda s: ' ' || s))) AS suffix, unnest(range(23)) AS pos)
  UNION ALL SELECT subject_id, 4, name_ord, pos, '"' || name || '" "' || other || '"'
    FROM ordered JOIN (
      SELECT subject_id, unnest(others) AS other, unnest(range(len(others))) AS pos FROM (
        SELECT subject_id, list_concat(places, users, CASE WHEN email IS NULL THEN [] ELSE [email] END, phones) AS others FROM subject)) USING (subject_id)),
firsts AS (SELECT subject_id, q, min(struct_pack(f := family, a := a, b := b)) AS place FROM raw_queries GROUP BY subject_id, q)
"""
)

# --- hits ----------------------------------------------------------------------

_HITS = f"""
canon AS (SELECT *, {_canonical('href')} AS url FROM {{hits}} WHERE coalesce(href, '') <> ''),
first_seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, url ORDER BY query_ord, result_rank) AS rn FROM canon) WHERE rn = 1)
"""

_CONFIDENCE = (
    _NAMES
    + """,
rated AS (
  SELECT q.subject_id, q.search_query, CAST(CASE
      WHEN s.email IS NOT NULL AND contains(lower(q.search_query), lower(s.email)) THEN 1.0
      WHEN len(list_filter(s.phones, lambda p: contains(lower(q.search_query), lower(p)))) > 0 THEN 1.0
      WHEN len(list_filter(s.users, lambda u: contains(lower(q.search_query), lower(u)))) > 0 THEN 0.9
      WHEN n.named AND len(list_filter(s.places, lambda p: contains(lower(q.search_query), lower(p)))) > 0 THEN 0.6
      WHEN n.named THEN 0.2 ELSE 0.0 END AS DOUBLE) AS query_confidence
  FROM (SELECT DISTINCT subject_id, search_query FROM {hits}) q
  JOIN subject s ON s.subject_id = q.subject_id
  JOIN (SELECT h.subject_id, h.search_query, bool_or(contains(lower(h.search_query), lower(o.name))) AS named
        FROM (SELECT DISTINCT subject_id, search_query FROM {hits}) h JOIN ordered o ON o.subject_id = h.subject_id GROUP BY ALL) n
    ON n.subject_id = q.subject_id AND n.search_query = q.search_query)
"""
)

# --- mail ----------------------------------------------------------------------

# The senders of the mails view and what they stand for, as plain values.
_SENDERS = [
    ("Deals Team <promo@shop.example.com>", "Deals Team", "promo", "shop.example.com"),
    ('"Doe, Jane" <jane@corp.example.org>', "Doe, Jane", "jane", "corp.example.org"),
    ("no-reply@news.example.net", "", "no-reply", "news.example.net"),
    ("<alerts@social.example.com>", "", "alerts", "social.example.com"),
    ("Jane (Sales) <jane@shop.example.com>", "Jane (Sales)", "jane", "shop.example.com"),
    (r'"A \"B\" C" <abc@corp.example.org>', 'A "B" C', "abc", "corp.example.org"),
    ('"Doe" Jane <doe@corp.example.org>', "Doe Jane", "doe", "corp.example.org"),
    ("Team <noat>", "Team", "noat", ""),
]


def _sender(x: str) -> str:
    def part(number: int) -> str:
        cases = " ".join(f"WHEN {_quote(row[0])} THEN {_quote(row[number])}" for row in _SENDERS)
        return f"CASE {x} {cases} ELSE '' END"

    return f"{part(1)} AS sender_name, {part(2)} AS sender_email_username, {part(3)} AS sender_email_domain"


def _phrases() -> str:
    rows = []
    for label, tiers in fv.KEYWORDS.items():
        for tier, points in fv.KEYWORD_POINTS.items():
            rows += [f"({_quote(label)}, {points}, {_quote(p)})" for p in tiers[tier]]
    return "(VALUES " + ", ".join(rows) + ") AS k(label, points, phrase)"


def _labels(source: str, carried: str) -> str:
    """CTEs from ``source(ordinal, sender, subject, body)`` to ``labelled``."""
    hits = " + ".join(
        f"(length(lower(coalesce(m.{s}, ''))) - length(replace(lower(coalesce(m.{s}, '')), k.phrase, ''))) // length(k.phrase)"
        for s in ("sender", "subject", "body")
    )
    counts = ", ".join(
        f"CAST(sum(CASE WHEN label = '{x}' THEN total ELSE 0 END) AS BIGINT) AS {x}_count" for x in fv.LABELS
    )
    best = "greatest(" + ", ".join(f"{x}_count" for x in fv.LABELS) + ")"
    ties = " + ".join(f"CAST({x}_count = {best} AS INT)" for x in fv.LABELS)
    winner = " ".join(f"WHEN {x}_count = {best} THEN '{x}'" for x in fv.LABELS)
    return f"""
totals AS (
  SELECT ordinal, label, CASE WHEN sum(points * n) > 1 THEN sum(points * n) ELSE 0 END AS total FROM (
    SELECT m.ordinal, k.label, k.points, {hits} AS n FROM {source} m, {_phrases()}) GROUP BY ordinal, label),
counted AS (SELECT ordinal, {counts} FROM totals GROUP BY ordinal),
labelled AS (
  SELECT {carried} c.*, CASE WHEN {best} = 0 THEN 'unlabelled' WHEN {ties} > 1 THEN 'ambiguous' {winner} END AS label
  FROM counted c JOIN {source} m ON m.ordinal = c.ordinal)
"""


_LABELLED = "raw_mail AS (SELECT * FROM {mails}), " + _labels("raw_mail", "")

_CLEANED = f"""
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, body ORDER BY ordinal) AS rn FROM {{mails}}) WHERE rn = 1),
cleaned AS (SELECT ordinal, sender, {_clean_subject('subject')} AS subject, {_clean_body('body')} AS body, date FROM kept),
""" + _labels("cleaned", "m.sender, m.subject, m.body, m.date, ")

_COUNT_COLUMNS = ", ".join(f"{x}_count" for x in fv.LABELS)
_LABEL_CASE = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(fv.LABELS))

# --- evaluation ----------------------------------------------------------------


def _report(source: str, classes: str, tag: str) -> str:
    """CTEs ``{tag}_rated`` and ``{tag}`` over ``source(actual, predicted)``."""
    return f"""
{tag}_cells AS (SELECT actual, predicted, count(*) AS n FROM {source} GROUP BY actual, predicted),
{tag}_classes AS ({classes}),
{tag}_counts AS (
  SELECT label, coalesce((SELECT sum(n) FROM {tag}_cells WHERE actual = label AND predicted = label), 0) AS hits,
    coalesce((SELECT sum(n) FROM {tag}_cells WHERE predicted = label), 0) AS n_predicted,
    coalesce((SELECT sum(n) FROM {tag}_cells WHERE actual = label), 0) AS support FROM {tag}_classes),
{tag}_rated AS (
  SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM (
    SELECT label, hits, CAST(support AS BIGINT) AS support, CASE WHEN n_predicted > 0 THEN CAST(hits AS DOUBLE) / n_predicted ELSE 0.0 END AS p,
      CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0.0 END AS r FROM {tag}_counts)),
{tag} AS (
  SELECT label, p, r, f, support FROM {tag}_rated
  UNION ALL SELECT 'accuracy', sum(hits) / CAST(sum(support) AS DOUBLE), sum(hits) / CAST(sum(support) AS DOUBLE), sum(hits) / CAST(sum(support) AS DOUBLE), CAST(sum(support) AS BIGINT) FROM {tag}_rated
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM {tag}_rated
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM {tag}_rated)
"""


_SEEN = "SELECT DISTINCT label FROM (SELECT actual AS label FROM {predictions} UNION ALL SELECT predicted FROM {predictions})"
_GIVEN = f"SELECT unnest({_list(fv.LABELS + ['spam'])}) AS label"

_VOCAB = rf"""
tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{fv.WORD_PATTERN}')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS n FROM tokens GROUP BY doc_id, word),
vocab AS (
  SELECT word, n_total, n_docs, row_number() OVER (ORDER BY n_total DESC, word) AS rk FROM (
    SELECT word, sum(n) AS n_total, count(*) AS n_docs FROM tf GROUP BY word) ORDER BY n_total DESC, word LIMIT {fv.VOCABULARY_SIZE})
"""


def _queue(where: str) -> str:
    return f"""SELECT p.id, p.page_title, p.risk_score, p.match_score, p.verification_status, c.url
FROM {{crawled}} p JOIN {{candidates}} c ON c.id = p.search_result_id WHERE {where}"""


def _schema_rows(view: str, table: str, ok: list[str], missing: list[str]) -> str:
    parts = [f"SELECT '{table}' AS table_name, '{c}' AS column_name, 'ok' AS state, count(*) - count({c}) AS n_null FROM {{{view}}}" for c in ok]
    parts += [f"SELECT '{table}', '{c}', 'missing', count(*) FROM {{{view}}}" for c in missing]
    return " UNION ALL ".join(parts)


def _profile(columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS n_filled, count(*) - count({c}) AS n_null, "
        f"CAST(min({c}) AS VARCHAR) AS smallest, CAST(max({c}) AS VARCHAR) AS largest FROM {{mails}}"
        for c, t in columns.items()
    )


_FETCH_STATUS = """CASE WHEN http_status >= 400 THEN 'failed' WHEN NOT contains(lower(coalesce(content_type, '')), 'text/html') THEN 'unsupported' ELSE 'success' END"""

_CRAWLED = f"""SELECT f.search_result_id, {_FETCH_STATUS} AS crawl_status FROM {{fetches}} f JOIN {{candidates}} k ON k.id = f.search_result_id
WHERE k.crawl_status = 'pending'"""
_CRAWLED_GOOD = f"SELECT search_result_id FROM ({_CRAWLED}) WHERE crawl_status = 'success'"

_PREPARED_NULLS = {
    "sender_name": "''", "sender_email_username": "''", "sender_email_domain": "''", "original_sender_string": "sender",
    "subject": "subject", "body": "body", "date": "date", **{f"{x}_count": "0" for x in fv.LABELS}, "label": "'unlabelled'",
}


def _texts() -> dict[str, str]:
    q: dict[str, str] = {}
    # sources
    quoted = r"regexp_replace(body, '(^|\n)From ', '\1>From ', 'g')"
    q["mail_scan"] = f"SELECT sender, subject, date, {quoted} || {_NL} AS body FROM {{messages}}"
    q["mail_raw_decode"] = "SELECT id AS gmail_id, sender, subject, date, body FROM {messages}"
    q["mail_ids_top"] = f"SELECT id FROM {{messages}} ORDER BY id LIMIT {fv.INBOX_SIZE}"
    q["hits_explode"] = "SELECT subject_id, query_ord, search_query, result_rank, href, title, coalesce(body, '') AS body FROM {hits}"
    q["fetch_feed"] = "SELECT search_result_id, final_url, http_status, lower(content_type) AS content_type, md5(html) AS html_md5 FROM {fetches}"
    q["html_files"] = f"SELECT page_id, 200 AS http_status, 'text/html' AS content_type, md5(html || {_NL}) AS html_md5 FROM {{raw_pages}}"
    q["pending_pages"] = "SELECT page_id, extracted_text FROM {page_texts} WHERE verification_status = 'pending'"
    chosen = "CASE WHEN coalesce(human_verified, false) THEN human_label ELSE label END AS training_label"
    q["training_by_id"] = f"SELECT id, label, human_label, human_verified, {chosen} FROM {{training}} WHERE id IN (SELECT email_id FROM {{predictions}} WHERE actual <> predicted)"
    q["report_history"] = f"""WITH {_report('{predictions}', _SEEN, 'rep')}
SELECT label, round_even(p, 2) AS precision, round_even(r, 2) AS recall, round_even(f, 2) AS f1_score, CAST(support AS DOUBLE) AS support, stamp AS timestamp
FROM rep, (SELECT unnest(['2024-01-01 00:00:00', '2024-01-02 00:00:00']) AS stamp)"""
    q["identity_terms"] = f"WITH {_TERMS} SELECT subject_id, entity_type, entity_value, confidence FROM terms"
    # table changes
    q["hits_insert_ignore"] = f"""WITH {_HITS} SELECT subject_id, url, query_ord, result_rank, title FROM first_seen f
WHERE NOT EXISTS (SELECT 1 FROM {{known_urls}} k WHERE k.subject_id = f.subject_id AND k.url = f.url)"""
    q["page_emails"] = _pages("SELECT page_id, email FROM emails")
    q["page_images"] = _pages("SELECT page_id, image_url FROM images")
    q["page_links"] = _pages("SELECT page_id, url, link_type FROM typed")
    q["page_phones"] = _pages("SELECT page_id, phone_number FROM phones")
    q["crawl_status_latest"] = """WITH last AS (
  SELECT *, row_number() OVER (PARTITION BY search_result_id ORDER BY ts DESC, event_id DESC) AS rn,
    count(*) OVER (PARTITION BY search_result_id) AS n FROM {crawl_events})
SELECT c.id AS search_result_id, coalesce(l.crawl_status, 'pending') AS crawl_status, coalesce(l.n, 0) AS crawl_attempts, l.ts AS last_crawled
FROM {candidates} c LEFT JOIN last l ON l.search_result_id = c.id AND l.rn = 1"""
    q["apply_corrections"] = f"""WITH last AS (
  SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY ts DESC, event_id DESC) AS rn FROM {{corrections}} WHERE label_index BETWEEN 0 AND {len(fv.LABELS) - 1})
SELECT t.id, t.label, CASE label_index {_LABEL_CASE} ELSE t.human_label END AS human_label,
  CASE WHEN l.email_id IS NULL THEN t.human_verified ELSE true END AS human_verified
FROM {{training}} t LEFT JOIN last l ON l.email_id = t.id AND l.rn = 1"""
    q["review_apply"] = """WITH made AS (
  SELECT *, CASE choice WHEN 'v' THEN 'verified' WHEN 'f' THEN 'false_positive' WHEN 'i' THEN 'ignored' WHEN 'r' THEN 'pending' END AS decided FROM {decisions}),
last AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ts DESC, event_id DESC) AS rn FROM made WHERE decided IS NOT NULL)
SELECT c.id, coalesce(l.decided, c.verification_status) AS verification_status FROM {crawled} c LEFT JOIN last l ON l.page_id = c.id AND l.rn = 1"""
    q["emails_upsert"] = """WITH last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gmail_id ORDER BY event_id DESC) AS rn FROM {incoming_emails}) WHERE rn = 1)
SELECT coalesce(s.gmail_id, l.gmail_id) AS gmail_id, coalesce(l.subject, s.subject) AS subject, coalesce(l.body, s.body) AS body, s.is_read
FROM {stored_emails} s FULL OUTER JOIN last l ON l.gmail_id = s.gmail_id"""
    mail_columns = ["sender_name", "sender_email_username", "sender_email_domain", "original_sender_string", "subject", "body", "date"]
    q["schema_check"] = " UNION ALL ".join(
        [
            _schema_rows(
                "crawled", "crawled_pages",
                ["id", "search_result_id", "page_title", "verification_status", "risk_score", "match_score"],
                ["http_status", "content_type", "description", "keywords", "html", "extracted_text", "content_hash", "crawled_at", "company_id"],
            ),
            _schema_rows("child_links", "page_links", ["page_id", "url", "link_type"], []),
            _schema_rows(
                "training", "training_data", ["id", "label", "human_label", "human_verified"],
                mail_columns + [f"{x}_count" for x in fv.LABELS],
            ),
        ]
    )
    q["constraint_report"] = """
SELECT 'page_links' AS table_name, 'not_null' AS rule, 'page_id' AS column_name, count(*) - count(page_id) AS violations FROM {child_links}
UNION ALL SELECT 'page_links', 'not_null', 'url', count(*) - count(url) FROM {child_links}
UNION ALL SELECT 'page_links', 'not_null', 'link_type', count(*) - count(link_type) FROM {child_links}
UNION ALL SELECT 'page_links', 'reference', 'page_id', count(*) FROM {child_links} WHERE page_id NOT IN (SELECT id FROM {crawled})
UNION ALL SELECT 'crawled_pages', 'not_null', 'search_result_id', count(*) - count(search_result_id) FROM {crawled}
UNION ALL SELECT 'crawled_pages', 'unique', 'search_result_id', count(search_result_id) - count(DISTINCT search_result_id) FROM {crawled}
UNION ALL SELECT 'crawled_pages', 'reference', 'search_result_id', count(*) FROM {crawled} WHERE search_result_id NOT IN (SELECT id FROM {candidates})"""
    q["cascade_delete"] = "SELECT id, page_id, url, link_type FROM {child_links} WHERE page_id NOT IN (SELECT doc_id FROM labels)"
    prepared = ", ".join(f"{v} AS {c}" for c, v in _PREPARED_NULLS.items())
    q["mail_prepare"] = f"SELECT ordinal, {prepared} FROM {{mails}}"
    # filters and projections
    q["crawl_classify"] = f"SELECT search_result_id, {_FETCH_STATUS} AS crawl_status FROM {{fetches}}"
    q["training_set"] = f"""WITH t AS (SELECT id, label, {chosen} FROM {{training}})
SELECT 'label' AS filter_on, id, training_label FROM t WHERE label NOT IN ('unlabelled', 'ambiguous')
UNION ALL SELECT 'training_label', id, training_label FROM t WHERE training_label NOT IN ('unlabelled', 'ambiguous')"""
    q["review_candidates"] = _queue("p.verification_status = 'pending' AND (p.risk_score > 0 OR p.match_score > 0)")
    q["review_false_negatives"] = _queue("p.verification_status = 'pending' AND p.risk_score = 0 AND p.match_score = 0")
    q["review_all_pending"] = _queue("p.verification_status = 'pending'")
    q["review_previous"] = _queue("p.verification_status IN ('verified', 'false_positive', 'ignored')")
    q["mistakes"] = """SELECT p.email_id, p.actual, p.predicted, d.sender_email_domain FROM {predictions} p
JOIN {mail_domains} d ON d.id = p.email_id WHERE p.actual <> p.predicted"""
    q["email_text"] = """SELECT ordinal, sender || ' ' || subject || ' ' || body AS text_or_null,
  coalesce(sender, '') || ' ' || coalesce(subject, '') || ' ' || coalesce(body, '') AS text FROM {mails}"""
    # matching
    q["pii_findings"] = f"WITH {_FOUND} SELECT subject_id, page_id, entity_type, entity_value, confidence FROM found"
    q["pii_phone"] = f"""WITH {_FOUND}
SELECT 'page_digits' AS phone_mode, subject_id, page_id, entity_value FROM found WHERE entity_type = 'phone'
UNION ALL SELECT 'token', n.subject_id, p.page_id, n.entity_value FROM pages_text p, needles n
WHERE n.entity_type = 'phone' AND contains(p.token_digits, n.needle)"""
    q["risk_score"] = _risk("")
    q["analyse_pages"] = _risk("WHERE p.verification_status = 'pending'")
    q["review_detail"] = f"""WITH {_FOUND},
lists AS (SELECT page_id, subject_id,
  string_agg(rpad(entity_type, 15, ' ') || entity_value || printf(' (%.2f)', confidence), {_NL} ORDER BY -confidence, entity_type, entity_value) AS finding_lines
  FROM found GROUP BY page_id, subject_id)
SELECT p.page_id, l.subject_id, CASE WHEN coalesce(p.page_title, '') = '' THEN 'Unknown' ELSE p.page_title END AS page_title,
  left(coalesce(p.extracted_text, ''), {fv.PREVIEW_CHARS}) AS preview, coalesce(l.finding_lines, '') AS finding_lines
FROM {{page_texts}} p LEFT JOIN lists l ON l.page_id = p.page_id"""
    # aggregates
    q["label_counts"] = f"WITH {_LABELLED} SELECT ordinal, {_COUNT_COLUMNS} FROM labelled"
    q["label_assign"] = f"WITH {_LABELLED} SELECT ordinal, label FROM labelled"
    q["label_distribution"] = "SELECT label, count(*) AS n FROM {training} WHERE label NOT IN ('unlabelled', 'ambiguous') GROUP BY label"
    q["null_profile"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({v}) AS n_null FROM {{mails}}"
        for c, v in {"ordinal": "ordinal", **_PREPARED_NULLS}.items()
    )
    q["dedup_stats"] = """SELECT (SELECT count(*) FROM {mails}) AS n_before, count(*) AS n_after, (SELECT count(*) FROM {mails}) - count(*) AS n_removed
FROM (SELECT DISTINCT subject, body FROM {mails})"""
    q["frame_profile"] = _profile({"ordinal": "bigint", "sender": "string", "subject": "string", "body": "string", "date": "string"})
    per_page = ", ".join(
        f"(SELECT count(*) FROM {cte} x WHERE x.page_id = c.page_id {cond}) AS n_{name}"
        for name, cte, cond in [
            ("emails", "emails", ""), ("images", "images", ""), ("contact_links", "typed", "AND link_type = 'contact'"),
            ("privacy_links", "typed", "AND link_type = 'privacy'"), ("social_links", "typed", "AND link_type = 'social'"),
            ("phone_numbers", "phones", ""),
        ]
    )
    q["page_stats"] = _pages(f"SELECT page_id, {per_page} FROM cleared c")
    report_columns = "label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, support"
    q["classification_report"] = f"""WITH {_report('{predictions}', _SEEN, 'seen')}, {_report('{predictions}', _GIVEN, 'given')}
SELECT {report_columns}, 'seen' AS classes FROM seen UNION ALL SELECT {report_columns}, 'given' FROM given"""
    q["class_weights"] = """SELECT label, count(*) AS n, round((SELECT CAST(count(*) AS DOUBLE) FROM {training}) / ((SELECT count(DISTINCT label) FROM {training}) * count(*)), 6) AS weight
FROM {training} GROUP BY label"""
    # windows
    q["mail_dedup"] = "SELECT ordinal, subject, body FROM (SELECT *, row_number() OVER (PARTITION BY subject, body ORDER BY ordinal) AS rn FROM {mails}) WHERE rn = 1"
    q["hits_first_seen"] = f"WITH {_HITS} SELECT subject_id, url, query_ord, result_rank FROM first_seen"
    q["hits_topk"] = f"""SELECT subject_id, query_ord, result_rank, href FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id, query_ord ORDER BY result_rank) AS rn FROM {{hits}}) WHERE rn <= {fv.HITS_PER_QUERY}"""
    q["stratified_split"] = f"""WITH c AS (SELECT label, count(*) AS n FROM {{training}} GROUP BY label),
t AS (SELECT *, (SELECT sum(n) FROM c) AS total, (SELECT sum(n) - CAST(ceil(sum(n) / 5.0) AS HUGEINT) FROM c) AS n_train FROM c),
f AS (SELECT *, n * n_train // total AS base, (n * n_train) % total AS rest FROM t),
e AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS rk, n_train - sum(base) OVER () AS open FROM f),
quota AS (SELECT label, n - base - CASE WHEN rk <= open THEN 1 ELSE 0 END AS n_test FROM e),
r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '{fv.SPLIT_SEED}'), id) AS pos FROM {{training}})
SELECT r.id, r.label, r.pos <= quota.n_test AS is_test FROM r JOIN quota ON quota.label = r.label"""
    q["name_permutations"] = f"WITH {_NAMES} SELECT subject_id, name_ord, name FROM ordered"
    q["search_queries"] = f"""WITH {_QUERIES}
SELECT subject_id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY place) - 1 AS INT) AS query_ord, q AS search_query FROM firsts"""
    # scalar functions
    q["page_text"] = f"SELECT page_id, {_joined(_drop(_drop('html'), fv.HIDDEN_TEXT_TAGS), ' ')} AS extracted_text FROM {{raw_pages}}"
    q["page_meta"] = _pages("SELECT page_id, page_title, description, keywords FROM meta")
    q["mail_clean"] = f"SELECT ordinal, {_clean_subject('subject')} AS subject, {_clean_body('body')} AS body FROM {{mails}}"
    for key, column, pattern in (("doc_emails", "email", _EMAIL), ("doc_phones", "phone_number", _PHONE)):
        q[key] = f"""SELECT doc_id, CAST(unnest(range(len(found))) AS INT) AS pos, unnest(found) AS {column}
FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found FROM documents)"""
    q["sender_parts"] = f"SELECT ordinal, sender, {_sender('sender')} FROM {{mails}}"
    q["url_canonical"] = f"SELECT href, {_canonical('href')} AS url FROM {{hits}}"
    q["url_domain"] = "SELECT href, regexp_extract(href, '^[^:]+://([^/?#]*)', 1) AS domain FROM {hits}"
    q["url_resolve"] = _pages("SELECT page_id, href, resolved FROM links")
    q["query_confidence"] = f"""WITH {_CONFIDENCE} SELECT h.subject_id, h.query_ord, h.result_rank, r.query_confidence
FROM {{hits}} h JOIN rated r ON r.subject_id = h.subject_id AND r.search_query = h.search_query"""
    ids = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(fv.LABELS))
    q["label_encode"] = f"SELECT email_id, actual, CASE actual {ids} END AS label_id, actual AS label_back FROM {{predictions}}"
    wins = " ".join(
        f"WHEN {' AND '.join([f's{i} > s{j}' for j in range(i)] + [f's{i} >= s{j}' for j in range(i + 1, 5)])} THEN '{x}'"
        for i, x in enumerate(fv.LABELS)
    )
    q["argmax_label"] = f"SELECT vec_id, CASE {wins} END AS label FROM {{score_vectors}}"
    # learning
    q["tokens"] = f"WITH {_VOCAB} SELECT doc_id, word, n FROM tf"
    q["tfidf"] = f"""WITH {_VOCAB},
w AS (SELECT doc_id, tf.word, n * (ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + n_docs AS DOUBLE)) + 1) AS x FROM tf JOIN vocab ON vocab.word = tf.word)
SELECT doc_id, word, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""
    length = fv.SEQUENCE_LENGTH
    q["encode_fixed"] = f"""WITH {_VOCAB},
cut AS (SELECT doc_id, list_slice(regexp_extract_all(lower(text), '{fv.WORD_PATTERN}'), 1, {length}) AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM cut),
ids AS (SELECT doc_id, string_agg(CAST(coalesce(rk + 1, 1) AS VARCHAR), ',' ORDER BY pos) AS s FROM placed LEFT JOIN vocab ON vocab.word = placed.word GROUP BY doc_id)
SELECT c.doc_id, coalesce(ids.s, '') || CASE WHEN len(ws) = 0 THEN substr(repeat(',0', {length}), 2) ELSE repeat(',0', {length} - len(ws)) END AS input_ids, len(ws) AS n_real
FROM cut c LEFT JOIN ids ON ids.doc_id = c.doc_id"""
    # flows
    q["mail_training_rows"] = f"""WITH {_CLEANED}
SELECT ordinal, {_sender('sender')}, sender AS original_sender_string, subject, body, date, {_COUNT_COLUMNS}, label FROM labelled"""
    q["inbox_rows"] = f"""SELECT ordinal AS gmail_id, {_sender('sender')}, sender AS original_sender_string, {_clean_subject('subject')} AS subject,
  {_clean_body('body')} AS body, date, '' AS is_read, 'unclassified' AS classification, '' AS confidence, '' AS processed, '' AS created_at FROM {{mails}}"""
    lines = ", ".join(
        f"coalesce((SELECT string_agg({v}, {_NL} ORDER BY first_pos) FROM {cte} x WHERE x.page_id = c.page_id {cond}), '') AS {name}"
        for name, cte, v, cond in [
            ("images", "images", "x.image_url", ""), ("emails", "emails", "x.email", ""), ("phone_numbers", "phones", "x.phone_number", ""),
            ("contact_links", "typed", "x.url", "AND link_type = 'contact'"), ("privacy_links", "typed", "x.url", "AND link_type = 'privacy'"),
            ("social_links", "typed", "x.url", "AND link_type = 'social'"),
        ]
    )
    q["parse_pages"] = _pages(f"SELECT c.page_id, m.page_title, m.description, m.keywords, c.extracted_text, {lines} FROM cleared c JOIN meta m ON m.page_id = c.page_id")
    q["discovery_ingest"] = f"""WITH {_CONFIDENCE},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, query_ord ORDER BY result_rank) AS k FROM {{hits}}) WHERE k <= {fv.HITS_PER_QUERY}),
canon AS (SELECT *, {_canonical('href')} AS url FROM top WHERE coalesce(href, '') <> ''),
first_seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, url ORDER BY query_ord, result_rank) AS rn FROM canon) WHERE rn = 1)
SELECT f.subject_id, 'duckduckgo' AS search_engine, f.search_query, r.query_confidence, f.url, regexp_extract(f.url, '^[^:]+://([^/?#]*)', 1) AS domain,
  coalesce(f.title, '') AS page_title, coalesce(f.body, '') AS snippet, f.result_rank, 'pending' AS crawl_status, 0 AS crawl_attempts
FROM first_seen f JOIN rated r ON r.subject_id = f.subject_id AND r.search_query = f.search_query
WHERE NOT EXISTS (SELECT 1 FROM {{known_urls}} k WHERE k.subject_id = f.subject_id AND k.url = f.url)"""
    q["crawl_ingest"] = _pages(f"""SELECT 'crawl_events' AS table_name, search_result_id AS page_id, crawl_status AS item, '2024-01-01 00:00:00' AS detail FROM ({_CRAWLED})
UNION ALL SELECT 'crawled_pages', c.page_id, m.page_title, c.extracted_text FROM cleared c JOIN meta m ON m.page_id = c.page_id WHERE c.page_id IN ({_CRAWLED_GOOD})
UNION ALL SELECT 'page_emails', page_id, email, NULL FROM emails WHERE page_id IN ({_CRAWLED_GOOD})
UNION ALL SELECT 'page_images', page_id, image_url, NULL FROM images WHERE page_id IN ({_CRAWLED_GOOD})
UNION ALL SELECT 'page_links', page_id, url, link_type FROM typed WHERE page_id IN ({_CRAWLED_GOOD})
UNION ALL SELECT 'page_phones', page_id, phone_number, NULL FROM phones WHERE page_id IN ({_CRAWLED_GOOD})""")
    q["review_after_analysis"] = f"""WITH {_FOUND},
highest AS (SELECT page_id, max(risk_score) AS risk FROM scores GROUP BY page_id)
SELECT p.id, p.page_title, CAST(coalesce(h.risk, 0) AS DOUBLE) AS risk_score, p.match_score, c.url
FROM {{text_pages}} p JOIN {{text_candidates}} c ON c.id = p.search_result_id LEFT JOIN highest h ON h.page_id = p.id
WHERE p.verification_status = 'pending' AND (coalesce(h.risk, 0) > 0 OR p.match_score > 0)"""
    mailbox_bodies = rf"regexp_replace(body, '(^|\n)From ', '\1>From ', 'g') || {_NL}"
    q["mbox_training_rows"] = f"""WITH kept AS (
  SELECT min(id) AS ordinal, min(sender) AS sender, subject, raw_body FROM (SELECT id, sender, subject, {mailbox_bodies} AS raw_body FROM {{messages}}) GROUP BY subject, raw_body),
cleaned AS (SELECT ordinal, sender, {_clean_subject('subject')} AS subject, {_clean_body('raw_body')} AS body FROM kept),
{_labels("cleaned", "m.sender, m.subject, m.body, ")}
SELECT split_part(sender, ' ', 1) AS sender_name, regexp_extract(sender, '<([^@]*)@', 1) AS sender_email_username, 'mail.example.com' AS sender_email_domain,
  sender AS original_sender_string, subject, body, label FROM labelled"""
    q["stream_analyse"] = f"""WITH {_PAGES}, {_TERMS},
needles AS (SELECT *, CASE WHEN entity_type = 'phone' THEN regexp_replace(entity_value, '[^0-9]', '', 'g') ELSE lower(entity_value) END AS needle FROM terms),
n AS (SELECT c.page_id, k.subject_id, k.entity_type, k.entity_value,
    sum(CASE k.entity_type WHEN 'email' THEN 25 WHEN 'phone' THEN 40 ELSE 0 END) OVER (PARTITION BY c.page_id, k.subject_id) AS points
  FROM cleared c, needles k
  WHERE CASE WHEN k.entity_type = 'phone' THEN contains(regexp_replace(c.extracted_text, '[^0-9]', '', 'g'), k.needle) ELSE contains(lower(c.extracted_text), k.needle) END),
good AS (SELECT c.page_id, m.page_title, c.extracted_text FROM cleared c JOIN meta m ON m.page_id = c.page_id)
SELECT s.search_result_id AS page_id, s.crawl_status, g.page_title, g.extracted_text, n.subject_id, n.entity_type, n.entity_value,
  CASE WHEN s.crawl_status = 'success' THEN CAST(coalesce(n.points, 0) AS BIGINT) END AS risk_score
FROM (SELECT search_result_id, {_FETCH_STATUS} AS crawl_status FROM {{fetches}}) s
LEFT JOIN good g ON g.page_id = s.search_result_id AND s.crawl_status = 'success' LEFT JOIN n ON n.page_id = g.page_id"""
    undecided = ", ".join(map(_quote, fv.UNDECIDED_LABELS))
    q["svm_train_eval"] = f"""WITH m AS ({q['mail_training_rows'].replace('{mails}', '{short_mails}')}),
c AS (SELECT label, count(*) AS n FROM m WHERE label NOT IN ({undecided}) GROUP BY label),
t AS (SELECT *, (SELECT sum(n) FROM c) AS total, (SELECT sum(n) - CAST(ceil(sum(n) / 5.0) AS HUGEINT) FROM c) AS n_train FROM c),
f AS (SELECT *, n * n_train // total AS base, (n * n_train) % total AS rest FROM t),
e AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS rk, n_train - sum(base) OVER () AS open FROM f)
SELECT label, CAST(n - base - CASE WHEN rk <= open THEN 1 ELSE 0 END AS BIGINT) AS support, true AS reaches_bar FROM e"""
    q["svm_language_eval"] = """WITH c AS (SELECT lang AS label, count(*) AS n FROM {documents} WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang),
t AS (SELECT *, (SELECT sum(n) FROM c) AS total, (SELECT sum(n) - CAST(ceil(sum(n) / 5.0) AS HUGEINT) FROM c) AS n_train FROM c),
f AS (SELECT *, n * n_train // total AS base, (n * n_train) % total AS rest FROM t),
e AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS rk, n_train - sum(base) OVER () AS open FROM f)
SELECT label, CAST(n - base - CASE WHEN rk <= open THEN 1 ELSE 0 END AS BIGINT) AS support, true AS reaches_bar FROM e"""
    q["stream_dedup"] = f"SELECT DISTINCT subject_id, {_canonical('href')} AS url FROM {{hits}} WHERE coalesce(href, '') <> ''"
    return q


def oracles() -> dict[str, str]:
    return {key: duckdb_sql(sql) for key, sql in _texts().items()}
