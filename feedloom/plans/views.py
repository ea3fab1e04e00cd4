"""Stand-in tables over the driver's tables, in SQL that Spark and DuckDB both read; {name} is a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from feedloom.plans.tables import table

_BOARD = "lower(n_name) AS provider, 'supplier-' || CAST(s_suppkey AS VARCHAR(20)) AS"

VIEWS = {
    # One row per supplier, with counters from its line items.
    "v_companies": f"""
        SELECT {_BOARD} slug, s_name AS name, 'https://jobs.example.com/' || CAST(s_suppkey AS VARCHAR(20)) AS careers_url,
          CASE s_suppkey % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'llm_scrape' ELSE 'playwright' END AS parsing_strategy,
          CASE s_suppkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'active' WHEN 2 THEN 'dormant' WHEN 3 THEN 'broken' ELSE 'denied' END AS status,
          CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST('2024-01-05 00:00:00' AS TIMESTAMP) + CAST(s_suppkey % 26 AS INT) * INTERVAL '1' DAY END AS last_fetched_at,
          CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 4 = 1 THEN NULL ELSE CAST('2024-01-04 00:00:00' AS TIMESTAMP) END AS last_success_at,
          CAST(NULL AS VARCHAR(10)) AS last_error,
          s_suppkey % 6 AS consecutive_failures, coalesce(seen, 0) AS postings_seen_total, coalesce(matched, 0) AS postings_matched_total,
          s_suppkey % 5 AS zero_yield_streak, s_suppkey % 9 = 0 AS url_suspect
        FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
        LEFT JOIN (SELECT l_suppkey, count(*) AS seen, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS matched FROM {{lineitem}} WHERE l_suppkey % 8 > 0 GROUP BY l_suppkey) ON l_suppkey = s_suppkey""",
    # One row per (order, line number): the cheapest of its line items.
    "v_postings": f"""
        SELECT {_BOARD} company_slug, CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) AS external_id, 'p' || CAST(o_custkey % 2 AS VARCHAR(20)) AS profile_id,
          p_name AS job_title, 'https://jobs.example.com/' || CAST(l_orderkey AS VARCHAR(20)) || '/' || CAST(l_linenumber AS VARCHAR(20)) AS job_url,
          CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'Remote, ' || n_name ELSE n_name END AS location, l_linenumber % 4 = 0 AS is_remote,
          o_orderdate AS posted_at, o_orderdate AS discovered_at, l_shipdate AS last_seen_at,
          CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL '5' DAY END AS removed_at,
          CASE WHEN l_quantity < 10 THEN NULL WHEN l_quantity < 20 THEN 'yellow' WHEN l_quantity < 30 THEN 'no-jd' WHEN l_quantity < 40 THEN 'gate-error' ELSE 'silent' END AS drop_stage,
          CASE WHEN l_quantity < 20 THEN o_orderdate + INTERVAL '1' DAY END AS notified_at, l_discount * 10 AS llm_confidence, CAST(NULL AS TIMESTAMP) AS jd_checked_at
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_shipdate) AS l_shipdate, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber)
        JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey""",
    "v_board_runs": """
        SELECT event_id AS run_id, 'p' || CAST(user_id % 4 AS VARCHAR(20)) AS provider, 'user-' || CAST(user_id AS VARCHAR(20)) AS company_slug, 'p0' AS profile_id, ts AS run_at,
          CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, event_id % 7 AS added, event_id % 3 AS removed, event_type, value
        FROM {events}""",
    "v_texts": """
        SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'Salary: $' || CAST(50 + o_custkey % 90 AS VARCHAR(20)) || 'k - $' || CAST(70 + o_custkey % 90 AS VARCHAR(20)) || 'k per annum'
          WHEN 1 THEN 'pay is $' || CAST(10 + o_custkey % 50 AS VARCHAR(20)) || '/hr' WHEN 2 THEN 'CTC: ' || CAST(5 + o_custkey % 20 AS VARCHAR(20)) || '-' || CAST(26 + o_custkey % 9 AS VARCHAR(20)) || ' LPA'
          WHEN 3 THEN 'Founded in 2024-2026' WHEN 4 THEN 'Minimum ' || CAST(o_custkey % 30 AS VARCHAR(20)) || '+ years of experience' WHEN 5 THEN 'Must be ' || CAST(10 + o_custkey % 15 AS VARCHAR(20)) || ' years of age, 3 years of practice needed in the field of work' ELSE '' END AS body,
          o_custkey
        FROM {orders}""",
    "v_gate": """
        SELECT doc_id, CAST(n_chars % 100 AS DOUBLE) / 100 AS match_score, CASE WHEN doc_id % 7 = 0 THEN 'soft' WHEN toxic = 1 THEN 'hard' END AS deal_breaker_severity,
          CASE WHEN doc_id % 14 = 0 THEN 'travel' END AS deal_breaker_hit, 'fits' AS reason, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 9 AS DOUBLE) END AS yoe_min,
          CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 12 AS DOUBLE) END AS yoe_max, source AS job_title
        FROM {documents} LEFT JOIN {labels} USING (doc_id)""",
    "v_recruiters": """
        SELECT 'c' || CAST(c_custkey AS VARCHAR(20)) || '@' || lower(c_mktsegment) || '.example.com' AS email, replace(c_name, '#', ' ') || CASE c_custkey % 3 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ', Inc' ELSE '' END AS company,
          CASE c_custkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'bounced' ELSE 'unverified' END AS status, c_custkey, c_mktsegment
        FROM {customer}""",
    "v_outreach": """
        SELECT o_orderkey AS id, 'p' || CAST(o_orderkey % 2 AS VARCHAR(20)) AS profile_id, 'c' || CAST(o_custkey AS VARCHAR(20)) || '@x.example.com' AS recruiter_email, o_orderdate AS drafted_at,
          CASE o_orderkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'sent' ELSE 'discarded' END AS status
        FROM {orders}""",
    "v_usage": """
        SELECT 'm' || CAST(conv_id % 3 AS VARCHAR(20)) AS model, CAST(length(text) AS BIGINT) AS prompt_tokens, CASE WHEN turn % 2 = 0 THEN CAST(length(text) AS BIGINT) ELSE 0 END AS cached_tokens
        FROM {conversations} WHERE role = 'assistant'""",
    # Registry rows as text; some are to be quarantined.
    "v_registry": """
        SELECT s_name AS name, CASE s_suppkey % 10 WHEN 3 THEN 'nope' ELSE 'https://jobs.example.com/' || CAST(s_suppkey AS VARCHAR(20)) END AS careers_url, lower(n_name) AS source, 'supplier-' || CAST(s_suppkey AS VARCHAR(20)) AS source_slug,
          'api' AS parsing_strategy, CASE s_suppkey % 10 WHEN 4 THEN 'weird' ELSE 'active' END AS status, CAST(NULL AS VARCHAR(20)) AS reason, CAST(NULL AS VARCHAR(20)) AS discovered_via, CAST(NULL AS VARCHAR(20)) AS discovered_at,
          'seen, "twice"' AS evidence, CASE WHEN s_suppkey % 10 IN (3, 8) THEN 'x' END AS tenant_url,
          CASE s_suppkey % 10 WHEN 5 THEN '{{bad' WHEN 6 THEN '[1]' WHEN 7 THEN NULL ELSE '{{"k":"' || CAST(s_suppkey AS VARCHAR(20)) || '"}}' END AS api_meta, 'c' AS category, CAST(NULL AS VARCHAR(20)) AS employer_type
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    # Contact cells of a raw tab: two addresses and one that is none, alternative names; and a manual tab for some.
    "v_contact_cells": """
        SELECT c_custkey, 'C' || CAST(c_custkey AS VARCHAR(20)) || '@' || c_mktsegment || '.example.com / broken, alt' || CAST(c_custkey AS VARCHAR(20)) || '@x.example.com' AS emails, replace(c_name, '#', ' ') || ' Pvt. Ltd.' AS company,
          CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) || '; ' || lower(c_mktsegment) || ' Inc' ELSE '' END AS alt_names, 'Person ' || CAST(c_custkey AS VARCHAR(20)) AS contact_name
        FROM {customer}""",
    # Drafts with a life of their own: gone drafts, sent ones, bounces and verified ones by the mailbox of v_mailbox.
    "v_drafts": """
        SELECT o_orderkey AS id, 'p' || CAST(o_orderkey % 2 AS VARCHAR(20)) AS profile_id, 'u' || CAST(o_custkey % 150 AS VARCHAR(20)) AS recruiter_email, 'Company ' || CAST(o_custkey AS VARCHAR(20)) AS company_name,
          CASE o_orderkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'sent' WHEN 2 THEN 'discarded' ELSE 'draft' END AS status, CAST('2024-01-01 00:00:00' AS TIMESTAMP) + CAST(o_orderkey % 29 AS INT) * INTERVAL '1' DAY AS drafted_at,
          CASE WHEN o_orderkey % 4 = 1 THEN CAST('2024-01-01 12:00:00' AS TIMESTAMP) + CAST(o_orderkey % 30 AS INT) * INTERVAL '1' DAY END AS sent_at, CAST(NULL AS TIMESTAMP) AS verified_at, CAST(NULL AS VARCHAR(20)) AS message_id,
          CAST(NULL AS VARCHAR(20)) AS failure_detail, CAST(NULL AS TIMESTAMP) AS last_checked_at, o_custkey % 10 AS run_id, CAST('2024-01-31' AS DATE) AS run_date, 'Role ' || CAST(o_orderkey AS VARCHAR(20)) AS title, o_orderkey % 3 = 0 AS green, CAST(o_custkey % 100 AS DOUBLE) / 100 AS score
        FROM {orders}""",
    "v_mailbox": """
        SELECT 'm' || CAST(event_id AS VARCHAR(20)) AS message_id, CASE WHEN event_type = 'purchase' THEN 'sent' ELSE 'bounce' END AS folder, 'u' || CAST(user_id AS VARCHAR(20)) AS address, ts AS internal_date, 'b' || CAST(event_id AS VARCHAR(20)) AS snippet
        FROM {events} WHERE event_type IN ('purchase', 'error')""",
    # Campaign records, some of them not sent.
    "v_blast": """
        SELECT 'p' || CAST(c_nationkey % 5 AS VARCHAR(20)) AS profile_id, year(o_orderdate) - 1991 AS batch, 'u' || CAST(o_custkey % 150 AS VARCHAR(20)) AS email, c_name AS company, CASE WHEN o_orderkey % 13 = 0 THEN 'skipped_invalid' ELSE 'drafted' END AS status,
          'a' || CAST(o_orderkey % 4 AS VARCHAR(20)) AS variant, CAST('2024-01-01 00:00:00' AS TIMESTAMP) + CAST(o_orderkey % 30 AS INT) * INTERVAL '1' DAY AS at, CASE WHEN o_orderkey % 6 = 0 THEN 'late' END AS note, o_orderkey
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # Board rows as they are crawled: some ids on several pages, some partitions crawled twice.
    "v_listing": """
        SELECT 'supplier-' || CAST(l_suppkey AS VARCHAR(20)) AS company_slug, 'g' AS provider, CAST(l_partkey % 40 AS VARCHAR(20)) AS external_id, CAST(l_linenumber AS INT) AS page, CAST(l_orderkey AS INT) AS pos, flag AS job_title, line AS jd_text
        FROM (SELECT l_suppkey, l_partkey, l_linenumber, l_orderkey, min(l_returnflag) AS flag, min(l_linestatus) AS line FROM {lineitem} GROUP BY l_suppkey, l_partkey, l_linenumber, l_orderkey)""",
}


def needs(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("VARCHAR(20)", "STRING").replace("VARCHAR(10)", "STRING")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in needs(sql)})


def with_views(sql: str) -> str:
    """DuckDB SQL: the statement with the views it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    plain = {t: t for v in used for t in needs(VIEWS[v])}
    if not used:
        return sql
    joint = ", " + sql[5:] if sql.startswith("WITH ") else " " + sql
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v].format(**plain)})" for v in used) + joint
