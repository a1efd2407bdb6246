"""SQL that gives the same rows as a query, where SQL can say it."""

from __future__ import annotations

_ROLE = """CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user'
            WHEN lower(trim(role)) IN ('assistant', 'bot') THEN 'assistant'
            WHEN lower(trim(role)) IN ('music', 'track') THEN 'music' END"""

_WHITE = r"'[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*'"

ORACLES = {
    "p7_found": rf"""
        WITH m AS (
            SELECT session_id, turn_number, {_ROLE} AS speaker, content,
                   content IS NOT NULL AND NOT regexp_full_match(content, {_WHITE}) AS visible
            FROM messages),
        t AS (
            SELECT session_id, turn_number,
                   count(DISTINCT CASE WHEN speaker = 'user' THEN coalesce('=' || content, '-') END) AS asked,
                   bool_or(speaker IS NOT DISTINCT FROM 'assistant') AS replied,
                   bool_or(speaker IS NULL) AS nameless,
                   bool_or(coalesce(speaker IN ('user', 'assistant'), false) AND visible) AS visible
            FROM m GROUP BY 1, 2),
        s AS (
            SELECT session_id, bool_or(visible) AS visible, bool_and(replied) AS replied,
                   bool_or(nameless) OR min(asked) = 0 OR max(asked) > 1 OR min(turn_number) <> 1
                       OR max(turn_number) <> count(turn_number) OR count(*) <> count(turn_number) AS broken
            FROM t GROUP BY 1)
        SELECT session_id, CASE WHEN NOT visible THEN 'empty' WHEN broken THEN 'broken' ELSE 'missing_reply' END AS reason
        FROM s WHERE NOT visible OR broken OR NOT replied
    """,
    "p4_spikes": rf"""
        WITH v AS (
            SELECT 'lyrics' AS field_name, sources['lyrics'] AS source, lyrics AS t FROM track_crawl
            UNION ALL SELECT 'caption', sources['caption'], caption FROM track_crawl),
        w AS (SELECT * FROM v WHERE t IS NOT NULL AND NOT regexp_full_match(t, {_WHITE})),
        e AS (SELECT field_name, source, 'chars' AS measure, length(t) AS length FROM w UNION ALL SELECT field_name, source, 'bytes', strlen(t) FROM w),
        c AS (SELECT field_name, source, measure, length, count(*) AS n FROM e GROUP BY ALL),
        a AS (
            SELECT x.field_name, x.source, x.measure, x.length, max(x.n) AS n, max(x.n) / greatest(coalesce(sum(y.n), 0) / 50.0::DOUBLE, 0.25::DOUBLE) AS times
            FROM c x LEFT JOIN c y ON y.field_name = x.field_name AND y.source IS NOT DISTINCT FROM x.source AND y.measure = x.measure
                AND abs(y.length - x.length) BETWEEN 1 AND 25
            GROUP BY 1, 2, 3, 4)
        SELECT field_name, source, measure, CAST(length AS INT) AS length, n, round(times, 2) AS times FROM a WHERE n >= 8 AND times >= 6
    """,
}
