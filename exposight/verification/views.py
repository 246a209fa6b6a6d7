"""Input views over the given tables, as SQL text both engines read alike.

``{name}`` stands for a given table or another view and is filled in by
``render``; everything else is plain SQL. The views add what the given tables
lack (identity data, planted terms, mail, links), derived row by row from them,
so their size follows the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    # Identity source: one subject per customer.
    "subjects": """
SELECT c_custkey AS subject_id,
       CASE c_custkey % 5 WHEN 0 THEN 'Ana' WHEN 1 THEN 'Bo' WHEN 2 THEN 'Cy' WHEN 3 THEN 'Di' ELSE 'Eli' END AS first_name,
       CASE c_custkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["Max"]' WHEN 2 THEN '["Bea","Cleo"]' ELSE '["Bea","Cleo","Dora"]' END AS middle_names,
       'Testwell' || CAST(c_custkey AS VARCHAR(20)) AS last_name,
       CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE 'User.' || CAST(c_custkey AS VARCHAR(20)) || '@mail.example.com' END AS email,
       CASE c_custkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN '["nick' || CAST(c_custkey AS VARCHAR(20)) || 'x"]'
            ELSE '["nick' || CAST(c_custkey AS VARCHAR(20)) || 'y","p' || lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0') || 't"]' END AS usernames,
       CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE '["Port ' || CAST(CAST(floor(c_custkey / 8.0) AS BIGINT) AS VARCHAR(20)) || '"]' END AS locations,
       CASE WHEN c_custkey % 6 = 5 THEN '["n/a"]' ELSE '["01632 960 ' || lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0') || '"]' END AS numbers
FROM {customer}
""",
    # Page text: every document; most whose subject exists have terms of it planted.
    "page_texts": """
SELECT d.doc_id AS page_id,
       CASE d.doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Page ' || CAST(d.doc_id AS VARCHAR(20)) END AS page_title,
       CASE WHEN d.doc_id % 97 = 0 THEN NULL ELSE d.text ||
         coalesce(CASE d.doc_id % 8
           WHEN 0 THEN ' Name: ' || upper(s.first_name) || ' ' || upper(s.last_name) || ' Email: ' || coalesce(lower(s.email), 'none')
           WHEN 1 THEN ' Username: NICK' || CAST(s.subject_id AS VARCHAR(20)) || 'X Location: port ' || CAST(CAST(floor(s.subject_id / 8.0) AS BIGINT) AS VARCHAR(20))
           WHEN 2 THEN ' Phone: (01632) 960-' || lpad(CAST(s.subject_id AS VARCHAR(20)), 6, '0')
           WHEN 3 THEN ' code 01632 then 960 and ' || lpad(CAST(s.subject_id AS VARCHAR(20)), 6, '0') || ' apart'
           WHEN 4 THEN ' ' || s.first_name || ' ' || s.last_name || ', Port ' || CAST(CAST(floor(s.subject_id / 8.0) AS BIGINT) AS VARCHAR(20)) || ', user.' || CAST(s.subject_id AS VARCHAR(20)) || '@mail.example.com, +01632 (960) ' || lpad(CAST(s.subject_id AS VARCHAR(20)), 6, '0')
           WHEN 5 THEN ' ' || s.first_name || ' Max ' || s.last_name
           WHEN 6 THEN ' ' || s.first_name || ' Bea Cleo ' || s.last_name || ' aka P' || lpad(CAST(s.subject_id AS VARCHAR(20)), 6, '0') || 'T'
           ELSE '' END, '') END AS extracted_text,
       CASE d.doc_id % 7 WHEN 1 THEN 'verified' WHEN 2 THEN 'ignored' ELSE 'pending' END AS verification_status
FROM {documents} d LEFT JOIN {subjects} s ON s.subject_id = d.doc_id
""",
    # Page texts as stored pages, and the addresses they came from.
    "text_pages": """
SELECT page_id AS id, page_id AS search_result_id, page_title, CAST(0 AS DOUBLE) AS risk_score,
       CAST(CASE WHEN page_id % 10 = 9 THEN 1 ELSE 0 END AS DOUBLE) AS match_score, verification_status
FROM {page_texts}
""",
    "text_candidates": """
SELECT doc_id AS id, 'https://' || coalesce(source, 'none') || '.example.com/' || CAST(doc_id AS VARCHAR(20)) AS url FROM {documents}
""",
    # Raw pages with the constructs the crawl lacks.
    "raw_pages": """
SELECT page_id, url, html ||
  CASE page_id % 4
    WHEN 0 THEN '<meta name="description" content="A &amp; B"><meta content="k1, k2" name="keywords"><img src="/i/a.png"><img src="b.png"><img src="/i/a.png"><img alt="none"><img alt="a>b" src="c.png"><p title="5 > 3">over</p>'
    WHEN 1 THEN '<a href="mailto:help@shop.example.com?subject=hi">Mail</a><a href="/legal/privacy"> Privacy <b>Policy</b></a><a href="../contact">Contact us</a>'
    WHEN 2 THEN '<a href="https://www.linkedin.com/company/x">in</a><a href="//github.com/x">Contact on git</a><a href="https://netflix.com/t">film</a><p>Call 01632 960 123 or +44 1632960456, write a.b@c.example.net</p>'
    ELSE '<noscript>hidden@x.example.com</noscript><svg><text>hid</text></svg><iframe src="q">z</iframe><a href="?p=2">next</a><a href="#top">top</a><!-- c@d.example.com --><ruby>word<rt>hint</rt></ruby><template>later</template><script>var q=1'
  END AS html
FROM {pages}
""",
    # Search hits: twelve pages per subject, three queries each.
    "page_subjects": """
SELECT s.subject_id, s.first_name, s.last_name, s.email, p.page_id, p.url,
       CAST(row_number() OVER (PARTITION BY s.subject_id ORDER BY p.page_id) AS INT) AS result_rank
FROM {pages} p JOIN {subjects} s ON s.subject_id = CAST(floor(p.page_id / 12.0) AS BIGINT)
""",
    "hits": """
SELECT h.subject_id, h.query_ord, h.search_query, h.result_rank,
       CASE WHEN h.page_id % 11 = 0 THEN ''
            WHEN h.query_ord = 1 THEN regexp_replace(h.url, '[?#].*$', '') || '?src=q1'
            WHEN h.query_ord = 2 THEN regexp_replace(h.url, '[?#].*$', '') || ';v=2#frag'
            ELSE h.url END AS href,
       'title ' || CAST(h.page_id AS VARCHAR(20)) AS title,
       CASE WHEN h.page_id % 5 = 0 THEN NULL ELSE 'snippet' END AS body
FROM (
  SELECT subject_id, page_id, url, result_rank, 0 AS query_ord, '"' || coalesce(email, 'none') || '" leak' AS search_query FROM {page_subjects}
  UNION ALL
  SELECT subject_id, page_id, url, result_rank, 1 AS query_ord, '"' || first_name || ' ' || last_name || '" "Port ' || CAST(CAST(floor(subject_id / 8.0) AS BIGINT) AS VARCHAR(20)) || '"' AS search_query FROM {page_subjects}
  UNION ALL
  SELECT subject_id, page_id, url, result_rank, 2 AS query_ord, '"nick' || CAST(subject_id AS VARCHAR(20)) || 'x" site:github.com' AS search_query FROM {page_subjects}
) h
""",
    # Candidates stored by earlier runs: the pages whose id is in labels.
    "known_urls": """
SELECT CAST(floor(p.page_id / 12.0) AS BIGINT) AS subject_id, p.page_id AS id, regexp_replace(p.url, '[?#].*$', '') AS url
FROM {pages} p WHERE p.page_id IN (SELECT doc_id FROM {labels})
""",
    "fetches": """
SELECT page_id AS search_result_id, url AS final_url,
       CASE WHEN page_id % 10 = 3 THEN 404 WHEN page_id % 10 = 7 THEN 500 ELSE 200 END AS http_status,
       CASE WHEN page_id % 6 = 1 THEN 'application/pdf' WHEN page_id % 6 = 2 THEN 'Text/HTML; charset=utf-8' WHEN page_id % 6 = 5 THEN '' ELSE 'text/html' END AS content_type,
       html
FROM {raw_pages}
""",
    "crawl_events": """
SELECT event_id, user_id AS search_result_id, CAST(ts AS VARCHAR(40)) AS ts,
       CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'unsupported' ELSE 'failed' END AS crawl_status
FROM {events}
""",
    "crawled": """
SELECT page_id AS id, page_id AS search_result_id,
       CASE WHEN page_id % 9 = 0 THEN NULL ELSE 'Page ' || CAST(page_id AS VARCHAR(20)) END AS page_title,
       CAST(CASE WHEN page_id % 13 = 0 THEN NULL ELSE (page_id % 4) * 25 END AS DOUBLE) AS risk_score,
       CAST(page_id % 3 AS DOUBLE) AS match_score,
       CASE page_id % 7 WHEN 1 THEN 'verified' WHEN 2 THEN 'false_positive' WHEN 3 THEN 'ignored' ELSE 'pending' END AS verification_status
FROM {pages}
""",
    "candidates": """
SELECT p.page_id AS id, p.url, CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'success' END AS crawl_status
FROM {pages} p LEFT JOIN {labels} l ON l.doc_id = p.page_id
""",
    # A mail table and newer rows for part of its ids and for unknown ones.
    "stored_emails": """
SELECT 'u' || CAST(c_custkey AS VARCHAR(20)) AS gmail_id, c_name AS subject, c_mktsegment AS body, 0 AS is_read FROM {customer}
""",
    "incoming_emails": """
SELECT 'u' || CAST(user_id * 12 AS VARCHAR(20)) AS gmail_id, event_type AS subject,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS body, event_id FROM {events}
""",
    "decisions": """
SELECT event_id, user_id AS page_id, CAST(ts AS VARCHAR(40)) AS ts,
       CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'f' WHEN 'signup' THEN 'i' WHEN 'purchase' THEN 'r' ELSE 's' END AS choice
FROM {events}
""",
    "child_links": """
SELECT event_id AS id, event_id % 300 AS page_id,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE 'https://l.example.com/' || CAST(event_id % 17 AS VARCHAR(20)) END AS url,
       CASE event_id % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'privacy' ELSE 'social' END AS link_type
FROM {events}
""",
    # Mail: every document is the body of one, most with phrases of a label planted.
    "mails": """
SELECT doc_id AS ordinal,
       CASE doc_id % 6
         WHEN 0 THEN 'Deals Team <promo@shop.example.com>'
         WHEN 1 THEN '"Doe, Jane" <jane@corp.example.org>'
         WHEN 2 THEN 'no-reply@news.example.net'
         WHEN 3 THEN '<alerts@social.example.com>'
         WHEN 4 THEN 'Odd Name <a@b@c.example.com>'
         ELSE CASE doc_id % 5
           WHEN 0 THEN 'Jane (Sales) <jane@shop.example.com>'
           WHEN 1 THEN '"A ' || chr(92) || '"B' || chr(92) || '" C" <abc@corp.example.org>'
           WHEN 2 THEN '"Doe" Jane <doe@corp.example.org>'
           WHEN 3 THEN 'Team <noat>'
           ELSE '' END END AS sender,
       CASE doc_id % 7
         WHEN 0 THEN 'Flash  Sale: buy now'
         WHEN 1 THEN 'Weekly digest'
         WHEN 2 THEN 'Verification code inside'
         WHEN 3 THEN 'We updated our privacy policy'
         WHEN 4 THEN ' {ZWSP}Introducing a new feature '
         WHEN 5 THEN 'Hello'
         ELSE NULL END AS subject,
       CASE doc_id % 10
         WHEN 0 THEN '<div><p>' || coalesce(text, '') || '</p><p>Free shipping &amp; discount code.</p><p>Ends {NBSP} soon</p></div>'
         WHEN 1 THEN 'wholesale ' || text
         WHEN 2 THEN text || ' sale and sale'
         WHEN 3 THEN text || ' GDPR: data subject, legal basis. Write to <dpo@corp.example.org>'
         WHEN 4 THEN 'Webinar today. Book a demo. Free trial. ' || text
         WHEN 5 THEN 'Someone mentioned you{ZWSP} and ' || text || ' commented on your post'
         WHEN 6 THEN '<p>Monthly newsletter: roundup and top stories</p>' || text
         WHEN 7 THEN ''
         WHEN 8 THEN text
         ELSE NULL END AS body,
       '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR(20)), 2, '0') || ' 08:00:00' AS date
FROM {documents}
""",
    # Short mail for the classifier: phrases of a label alone.
    "short_mails": """
SELECT event_id AS ordinal,
       CASE event_id % 6
         WHEN 0 THEN 'Deals Team <promo@shop.example.com>'
         WHEN 1 THEN '"Doe, Jane" <jane@corp.example.org>'
         WHEN 2 THEN 'no-reply@news.example.net'
         WHEN 3 THEN '<alerts@social.example.com>'
         WHEN 4 THEN 'Odd Name <a@b@c.example.com>'
         ELSE CASE event_id % 5
           WHEN 0 THEN 'Jane (Sales) <jane@shop.example.com>'
           WHEN 1 THEN '"A ' || chr(92) || '"B' || chr(92) || '" C" <abc@corp.example.org>'
           WHEN 2 THEN '"Doe" Jane <doe@corp.example.org>'
           WHEN 3 THEN 'Team <noat>'
           ELSE '' END END AS sender,
       CASE event_id % 7
         WHEN 0 THEN 'Flash  Sale: buy now'
         WHEN 1 THEN 'Weekly digest'
         WHEN 2 THEN 'Verification code inside'
         WHEN 3 THEN 'We updated our privacy policy'
         WHEN 4 THEN ' {ZWSP}Introducing a new feature '
         WHEN 5 THEN 'Hello'
         ELSE NULL END AS subject,
       CASE event_id % 10
         WHEN 0 THEN '<p>Free shipping &amp; discount code.</p><p>Ends {NBSP} soon</p>'
         WHEN 1 THEN 'wholesale'
         WHEN 2 THEN 'sale and sale'
         WHEN 3 THEN 'GDPR: data subject, legal basis. Write to <dpo@corp.example.org>'
         WHEN 4 THEN 'Webinar today. Book a demo. Free trial.'
         WHEN 5 THEN 'Someone mentioned you{ZWSP} and commented on your post'
         WHEN 6 THEN 'Monthly newsletter: roundup and top stories'
         WHEN 7 THEN ''
         WHEN 8 THEN 'text ' || CAST(event_id AS VARCHAR(20))
         ELSE NULL END AS body,
       CAST(ts AS VARCHAR(40)) AS date
FROM {events}
""",
    # Messages as they land from a mailbox: one per conversation turn.
    "messages": """
SELECT 'c' || CAST(conv_id AS VARCHAR(20)) || 't' || CAST(turn AS VARCHAR(20)) AS id,
       role || ' <' || role || CAST(conv_id AS VARCHAR(20)) || '@mail.example.com>' AS sender,
       CASE WHEN turn % 5 = 4 THEN '' ELSE 'Conversation ' || CAST(conv_id AS VARCHAR(20)) || ' turn ' || CAST(turn AS VARCHAR(20)) END AS subject,
       'Mon, 01 Jan 2024 00:00:0' || CAST(turn % 10 AS VARCHAR(20)) || ' +0000' AS date,
       text AS body
FROM {conversations}
""",
    "predictions": """
SELECT event_id AS email_id,
       CASE event_id % 5 WHEN 0 THEN 'advertising' WHEN 1 THEN 'marketing' WHEN 2 THEN 'privacy' WHEN 3 THEN 'newsletter' ELSE 'notification' END AS actual,
       CASE WHEN event_id % 7 = 0 THEN 'marketing' WHEN event_id % 5 = 0 THEN 'advertising' WHEN event_id % 5 = 1 THEN 'marketing' WHEN event_id % 5 = 2 THEN 'privacy' WHEN event_id % 5 = 3 THEN 'newsletter' ELSE 'newsletter' END AS predicted
FROM {events}
""",
    "mail_domains": """
SELECT event_id AS id, 'd' || CAST(event_id % 4 AS VARCHAR(20)) || '.example.com' AS sender_email_domain FROM {events}
""",
    "training": """
SELECT event_id AS id,
       CASE event_id % 7 WHEN 0 THEN 'advertising' WHEN 1 THEN 'marketing' WHEN 2 THEN 'privacy' WHEN 3 THEN 'newsletter' WHEN 4 THEN 'notification' WHEN 5 THEN 'ambiguous' ELSE 'unlabelled' END AS label,
       CASE WHEN event_id % 4 = 0 THEN 'privacy' ELSE NULL END AS human_label,
       event_id % 8 = 0 AS human_verified
FROM {events}
""",
    "corrections": """
SELECT user_id AS email_id, event_id, CAST(ts AS VARCHAR(40)) AS ts, CAST(event_id % 6 AS INT) AS label_index FROM {events}
""",
    # Class scores per row: the first five components of each embedding.
    "score_vectors": """
SELECT vec_id, CAST(embedding[{first}] AS DOUBLE) AS s0, CAST(embedding[{first} + 1] AS DOUBLE) AS s1, CAST(embedding[{first} + 2] AS DOUBLE) AS s2,
       CAST(embedding[{first} + 3] AS DOUBLE) AS s3, CAST(embedding[{first} + 4] AS DOUBLE) AS s4
FROM {embeddings}
""",
}

_CHARS = {"ZWSP": chr(0x200B), "NBSP": chr(0x00A0)}


def render(text: str, table_ref, first_index: int) -> str:
    """Fill in every ``{name}``: tables by ``table_ref(name)``, views as subqueries."""

    def fill(match: re.Match) -> str:
        name = match.group(1)
        if name in _CHARS:
            return _CHARS[name]
        if name == "first":
            return str(first_index)
        if name in VIEWS:
            return "(" + render(VIEWS[name], table_ref, first_index).strip() + ")"
        if name in TABLES:
            return table_ref(name)
        raise KeyError(name)

    return re.sub(r"\{([a-z_]+|ZWSP|NBSP)\}", fill, text)


def duckdb_sql(text: str) -> str:
    return render(text, lambda name: name, first_index=1)


def given_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the given tables of one folder. ``text`` may be a view's name."""

    def table_ref(name: str) -> str:
        folder = re.sub(r"\W", "_", sf_dir.strip("/"))
        given_table(spark, sf_dir, name).createOrReplaceTempView(f"given_{folder}_{name}")
        return f"given_{folder}_{name}"

    sql = VIEWS[text] if text in VIEWS else text
    return spark.sql(render(sql, table_ref, first_index=0))
