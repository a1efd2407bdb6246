"""SQL with the same rows as the registered queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions.text import NOISE, SEARCH_NOISE, SPELLINGS, STOP_WORDS

_MSG = """m AS (SELECT session_id, turn_number,
    CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'bot') THEN 'assistant'
         WHEN lower(trim(role)) IN ('music', 'track') THEN 'music' END AS speaker, content, min(msg_id) AS msg_id
    FROM messages GROUP BY 1, 2, 3, 4)"""
_TURNS = f"""{_MSG}, t AS (SELECT session_id, turn_number, count(*) AS n_messages,
    arg_min(content, msg_id) FILTER (WHERE speaker = 'user' AND content IS NOT NULL) AS query,
    coalesce(list(content ORDER BY msg_id) FILTER (WHERE speaker = 'music' AND content IS NOT NULL), []) AS tracks FROM m GROUP BY 1, 2)"""
_FIRST = "list_filter({0}, lambda x: trim(x) <> '')[1]"
_PLAIN = "regexp_replace(regexp_replace(lower(trim(x)), '\\s+', ' ', 'g'), '[.,;:!?]+$', '')"
_SPELL = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items()) + " ELSE {0} END"
_NOISY = " OR ".join(f"regexp_matches(y, '{p}')" for p in NOISE)


#: Labels and cuts of popularity as the definition states them: 20, 40, 60 and 80 belong to the lower word.
_POPULARITY = "CASE WHEN pop <= 20 THEN 'obscure' WHEN pop <= 40 THEN 'niche' WHEN pop <= 60 THEN 'moderate popularity' WHEN pop <= 80 THEN 'highly popular' WHEN pop > 80 THEN 'mainstream hit' END"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _distinct(xs: str) -> str:
    """Distinct elements in order of first appearance."""
    return f"list_filter({xs}, lambda v, i: list_position({xs}, v) = i)"


_LISTED = "coalesce(array_to_string(list_transform({0}, lambda x: coalesce(x, '')), chr(31)), '')"
_T = f"""c AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY coalesce(popularity, -1) DESC, {_LISTED.format('track_name')} DESC, {_LISTED.format('artist_name')} DESC,
    {_LISTED.format('album_name')} DESC, coalesce(release_date, '') DESC, coalesce(duration, -1) DESC, {_LISTED.format('tag_list')} DESC) AS place FROM tracks WHERE track_id IS NOT NULL) WHERE place = 1),
 c1 AS (SELECT *, list_transform(list_transform(coalesce(tag_list, []), lambda x: {_PLAIN}), lambda y: {_SPELL.format('y')}) AS plain,
    list_filter(list_transform(coalesce(tag_list, []), lambda x: lower(trim(x))), lambda y: length(y) >= 2 AND NOT regexp_matches(y, '\\d') AND NOT regexp_matches(y, '^({"|".join(SEARCH_NOISE)})')) AS searched FROM c),
 c2 AS (SELECT *, list_filter({_distinct('plain')}, lambda y: NOT (y = '' OR length(y) > 30 OR {_NOISY})) AS tags, {_distinct('searched')} AS stags,
    nullif(regexp_extract(coalesce(release_date, ''), '^(\\d{{4}})', 1), '') AS year, CAST(round_even(popularity, 0) AS INT) AS pop FROM c1)"""
_DOC = f"""{_T}, docs AS (SELECT track_id, lower(concat_ws(', ', 'title: ' || coalesce({_FIRST.format('track_name')}, 'unknown'), 'artist: ' || coalesce({_FIRST.format('artist_name')}, 'unknown'),
    'album: ' || coalesce({_FIRST.format('album_name')}, 'unknown'), 'year: ' || year, 'popularity: ' || pop,
    CASE WHEN len(tags) > 0 THEN 'tags: ' || array_to_string(tags[1:5], ' ') END)) AS doc FROM c2)"""

_POOLS = """q AS (SELECT pair_id, session_id, split, turn_number, specificity, track_id AS truth, seen, bm25_top_tids FROM train_pairs WHERE split <> 'train'),
 top AS (SELECT track_id, count(*) AS n FROM train_pairs WHERE split = 'train' AND track_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, track_id LIMIT 100),
 topr AS (SELECT track_id, row_number() OVER (ORDER BY n DESC, track_id) - 1 AS rank FROM top),
 rk0 AS (SELECT pair_id, 'bm25' AS pool, 0 AS pool_ord, track_id, min(rank) AS rank FROM
            (SELECT pair_id, unnest(bm25_top_tids) AS track_id, unnest(range(len(bm25_top_tids))) AS rank FROM q) WHERE track_id IS NOT NULL GROUP BY 1, 4
         UNION ALL SELECT pair_id, 'popular', 1, topr.track_id, topr.rank FROM q CROSS JOIN topr),
 gone AS (SELECT DISTINCT pair_id, unnest(seen) AS track_id FROM q),
 rk AS (SELECT rk0.* FROM rk0 ANTI JOIN gone ON rk0.pair_id = gone.pair_id AND rk0.track_id = gone.track_id)"""


def _fuse(value: str) -> str:
    return f"""{_POOLS}, fu AS (SELECT pair_id, track_id, round(CAST(sum(CAST({value} AS DECIMAL(20,15))) AS DOUBLE), 12) AS score, min(pool_ord * 100000 + rank) AS first FROM rk GROUP BY 1, 2),
 fr AS (SELECT pair_id, track_id, score, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, first, track_id) - 1 AS rank FROM fu)"""


_RRF = _fuse("1.0::DOUBLE / (61 + rank)")
_SCORES = f"""{_RRF}, hit AS (SELECT q.pair_id, fr.rank FROM q JOIN fr ON fr.pair_id = q.pair_id AND fr.track_id = q.truth AND fr.rank < 20),
 sc AS (SELECT q.pair_id, q.split, CAST(q.turn_number AS DOUBLE) AS turn_number, coalesce(upper(trim(q.specificity)), 'unknown') AS specificity, 1 AS n_truth, CASE WHEN rank IS NULL THEN 0 ELSE 1 END AS hits,
    CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS recall, coalesce(1.0::DOUBLE / log2(rank + 2), 0) AS ndcg, coalesce(1.0::DOUBLE / (rank + 1), 0) AS mrr
    FROM q LEFT JOIN hit ON hit.pair_id = q.pair_id WHERE q.truth IS NOT NULL)"""
_BLANK = "coalesce(trim({0}, ' \\t\\r\\n') = '', true)".replace("' \\t\\r\\n'", "' ' || chr(9) || chr(13) || chr(10)")


def _b(c: str) -> str:
    return _BLANK.format(c)


_LEN = "length(trim({0}, ' ' || chr(9) || chr(13) || chr(10)))"
_UNPRINTED = "(length({0}) >= 20 AND length(regexp_replace({0}, '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}\\p{{Z}}]', '', 'g')) + length({0}) - length(regexp_replace({0}, '[ \\n\\r\\t]', '', 'g')) < 0.5 * length({0}))"
_FLAGS = f"""ln AS (SELECT crawl_id, lower(trim(l, ' ' || chr(9))) AS line FROM (SELECT crawl_id, unnest(string_split_regex(lyrics, '\\r\\n|\\r|\\n')) AS l FROM track_crawl)),
 lc AS (SELECT crawl_id, line, count(*) AS n FROM ln WHERE line <> '' GROUP BY 1, 2),
 lf AS (SELECT crawl_id, bool_and(regexp_matches(line, '^\\s*[\\[\\(]?\\s*instrumental\\s*[\\]\\)]?\\s*$')) AS instrumental, sum(n) >= 4 AND max(n) >= 0.5 * sum(n) AS dominated FROM lc GROUP BY 1),
 fl AS (SELECT c.crawl_id, list_sort(list_filter([
    CASE WHEN {_b('lyrics')} THEN 'lyrics_empty' END,
    CASE WHEN NOT {_b('lyrics')} AND {_LEN.format('lyrics')} < 100 THEN 'lyrics_too_short' END,
    CASE WHEN NOT {_b('lyrics')} AND length(lyrics) > 100000 THEN 'lyrics_too_long' END,
    CASE WHEN NOT {_b('lyrics')} AND coalesce(instrumental, false) THEN 'lyrics_instrumental_marker' END,
    CASE WHEN NOT {_b('lyrics')} AND coalesce(dominated, false) THEN 'lyrics_repeated_line_dominant' END,
    CASE WHEN NOT {_b('lyrics')} AND {_UNPRINTED.format('lyrics')} THEN 'lyrics_mostly_non_printable' END,
    CASE WHEN NOT {_b('caption')} AND {_UNPRINTED.format('caption')} THEN 'caption_mostly_non_printable' END,
    CASE WHEN NOT {_b('lyrics')} AND regexp_matches(lyrics, '(?i)(instrumental track that has no lyrics|this song is an instrumental|no lyrics? (available|found))') THEN 'lyrics_apology' END,
    CASE WHEN {_b('caption')} THEN 'caption_empty' END,
    CASE WHEN NOT {_b('caption')} AND {_LEN.format('caption')} < 30 THEN 'caption_too_short' END,
    CASE WHEN NOT {_b('caption')} AND length(caption) > 5000 THEN 'caption_too_long' END,
    CASE WHEN {_b('chord')} THEN 'chord_empty' END, CASE WHEN {_b('music_key')} THEN 'key_empty' END, CASE WHEN {_b('tempo')} THEN 'tempo_empty' END,
    CASE WHEN NOT {_b('tempo')} AND NOT coalesce(TRY_CAST(trim(tempo) AS DOUBLE) BETWEEN 30 AND 300, false) THEN 'tempo_invalid' END,
    CASE WHEN {_b('mbid')} THEN 'mbid_missing' END], lambda x: x IS NOT NULL)) AS flags
   FROM track_crawl c LEFT JOIN lf ON lf.crawl_id = c.crawl_id)"""
_SDATE = """s AS (SELECT session_id, max(user_id) AS user_id, max(session_date) AS sd FROM sessions GROUP BY 1),
 sd AS (SELECT session_id, user_id, CASE WHEN trim(sd) <> '' THEN sd END AS session_date FROM s WHERE trim(coalesce(user_id, '')) <> '')"""
_PAIRS = f"""{_MSG}, o AS (SELECT *, lag(speaker) OVER w AS who, lag(content) OVER w AS said FROM m
    WHERE speaker IN ('user', 'music') AND trim(coalesce(content, '')) <> ''
    WINDOW w AS (PARTITION BY session_id ORDER BY turn_number, CASE WHEN speaker = 'user' THEN 0 ELSE 1 END, msg_id)),
 rp AS (SELECT session_id, turn_number, said AS utterance, content AS track_id FROM o WHERE speaker = 'music' AND who = 'user')"""
_KEY = "lower(replace(session_id, '-', ''))"


def _folds(rows: str) -> str:
    return f"""fg AS (SELECT g, (row_number() OVER (ORDER BY md5('42|' || g), g) - 1) % 5 AS fold FROM (SELECT DISTINCT {_KEY} AS g FROM {rows}))"""


_DECADES = {
    "thirties": 1930, "forties": 1940, "fifties": 1950, "sixties": 1960, "seventies": 1970, "eighties": 1980, "nineties": 1990, "aughts": 2000, "noughties": 2000, "tens": 2010, "twenties": 2020,
}


def _eras(text: str) -> str:
    """Decades of a text, numbers before words, with repeats."""
    number = "regexp_extract(x, '(\\d+)', 1)"
    return f"""(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '(\\b(?:(?:19|20)\\d{{2}}s?|''?\\d{{2}}s)\\b)', 1), lambda x: CASE WHEN length({number}) = 2 THEN CASE WHEN CAST({number} AS INT) >= 30 THEN '19' ELSE '20' END
        || substring({number}, 1, 1) ELSE substring({number}, 1, 3) END || '0s') || list_transform(regexp_extract_all(lower(coalesce({text}, '')), '\\b({"|".join(_DECADES)})\\b', 1), lambda w: CASE w {" ".join(f"WHEN '{w}' THEN '{y}s'" for w, y in _DECADES.items())} END))"""


_UNIT = "('0x' || substring(md5({0}), 1, 8))::BIGINT::DOUBLE / 4294967296.0"
_WIDE = f"""{_RRF}, wide AS (SELECT pair_id, track_id, min(CASE WHEN pool = 'bm25' THEN rank + 1 END) AS rank_bm25, min(CASE WHEN pool = 'popular' THEN rank + 1 END) AS rank_popular FROM rk GROUP BY 1, 2),
 ft AS (SELECT fr.pair_id, fr.track_id, fr.rank, q.session_id, rank_bm25, rank_popular, CASE WHEN fr.track_id = q.truth THEN 1 ELSE 0 END AS label
    FROM fr JOIN q ON q.pair_id = fr.pair_id LEFT JOIN wide ON wide.pair_id = fr.pair_id AND wide.track_id = fr.track_id WHERE fr.rank < 20)"""

ORACLES = {
    "turn_slices": f"""WITH {_TURNS}, h AS (SELECT *, coalesce(sum(n_messages) OVER w, 0) AS n_history, list_sort(list_distinct(flatten(coalesce(list(tracks) OVER w, [])))) AS seen
        FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT session_id, turn_number, query, array_to_string(tracks, '|') AS tracks, CAST(n_history AS BIGINT) AS n_history, coalesce(array_to_string(seen, '|'), '') AS seen FROM h WHERE query IS NOT NULL AND len(tracks) > 0""",
    "last_turns": f"""WITH {_MSG}, r AS (SELECT *, count(*) OVER (PARTITION BY session_id) - 1 AS n_history, row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC, msg_id DESC, speaker DESC NULLS LAST, content DESC NULLS LAST) AS p FROM m)
        SELECT session_id, turn_number, speaker, content AS query, n_history FROM r WHERE p = 1""",
    "strata": """WITH s AS (SELECT session_id, regexp_replace(lower(trim(max(user_profile.user_split))), '^test_', '') AS sp, upper(trim(max(conversation_goal.specificity))) AS spec, upper(trim(max(conversation_goal.category))) AS cat FROM sessions GROUP BY 1)
        SELECT session_id, CASE WHEN sp IN ('warm', 'cold', 'train') THEN sp ELSE 'unknown' END AS split, CASE WHEN spec IN ('HH', 'HL', 'LH', 'LL') THEN spec ELSE 'unknown' END AS specificity,
               CASE WHEN regexp_matches(cat, '^[A-K]$') THEN cat ELSE 'unknown' END AS category FROM s""",
    "popularity": "SELECT track_id, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, track_id) - 1 AS INT) AS rank FROM train_pairs WHERE split = 'train' AND track_id IS NOT NULL GROUP BY 1",
    "popular_top20": "SELECT track_id, count(*) AS n FROM train_pairs WHERE split = 'train' AND track_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, track_id LIMIT 20",
    "seen_filter": """WITH q AS (SELECT pair_id, seen, bm25_top_tids FROM train_pairs WHERE split <> 'train'),
        r AS (SELECT pair_id, unnest(bm25_top_tids) AS track_id, unnest(range(len(bm25_top_tids))) AS rank FROM q), g AS (SELECT DISTINCT pair_id, unnest(seen) AS track_id FROM q),
        k AS (SELECT r.*, row_number() OVER (PARTITION BY r.pair_id ORDER BY rank) - 1 AS place FROM r ANTI JOIN g ON g.pair_id = r.pair_id AND g.track_id = r.track_id WHERE r.track_id IS NOT NULL)
        SELECT pair_id, track_id, CAST(place AS INT) AS place FROM k WHERE place < 10""",
    "rrf_fusion": f"WITH {_RRF} SELECT pair_id, track_id, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM fr WHERE rank < 20",
    "rbc_fusion": f"WITH {_fuse('pow(0.9::DOUBLE, rank)')} SELECT pair_id, track_id, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM fr WHERE rank < 20",
    "recommend_top20": f"WITH {_RRF} SELECT pair_id, track_id, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM fr WHERE rank < 20",
    "eval_per_query": f"WITH {_SCORES} SELECT pair_id, CAST(n_truth AS BIGINT) AS n_truth, CAST(hits AS BIGINT) AS hits, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM sc",
    "eval_strata": f"""WITH {_SCORES} SELECT split, turn_number, specificity, count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(recall), 6) AS recall_capped, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr
        FROM sc GROUP BY GROUPING SETS ((), (split), (turn_number), (specificity), (turn_number, specificity))""",
    "catalog_diversity": f"""WITH {_RRF} SELECT (SELECT count(DISTINCT track_id) FROM fr WHERE rank < 20) AS n_shown, (SELECT count(DISTINCT track_id) FROM tracks) AS n_catalog,
        round((SELECT count(DISTINCT track_id) FROM fr WHERE rank < 20)::DOUBLE / (SELECT count(DISTINCT track_id) FROM tracks), 6) AS diversity""",
    "lexical_diversity": f"""WITH {_MSG}, w AS (SELECT list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> '') AS w FROM m WHERE speaker = 'assistant' AND content IS NOT NULL),
        p AS (SELECT unnest(list_zip(w[1:len(w)-1], w[2:len(w)])) AS p FROM w WHERE len(w) > 1)
        SELECT count(DISTINCT p) AS n_distinct, count(*) AS n_total, round(count(DISTINCT p)::DOUBLE / count(*), 6) AS distinct2 FROM p""",
    "tag_freq": f"WITH {_T} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM c2) GROUP BY 1",
    "track_features": f"""WITH {_T} SELECT track_id, {_FIRST.format('track_name')} AS title, year, (CAST(year AS INT) // 10 * 10) || 's' AS decade,
        CASE WHEN CAST(year AS INT) % 10 <= 3 THEN 'early ' WHEN CAST(year AS INT) % 10 <= 6 THEN 'mid ' ELSE 'late ' END || (CAST(year AS INT) // 10 * 10) || 's' AS era, CAST(pop AS DOUBLE) AS popularity,
        'p' || (pop // 10 * 10) || '-' || (pop // 10 * 10 + 9) AS bucket,
        {_POPULARITY} AS phrase,
        coalesce(array_to_string(tags, '|'), '') AS tags, coalesce(array_to_string(stags, '|'), '') AS search_tags FROM c2""",
    "track_text": f"WITH {_DOC} SELECT track_id, doc, substring(sha256(doc), 1, 16) AS doc_hash FROM docs",
    "quality_flags": f"WITH {_FLAGS} SELECT crawl_id, coalesce(array_to_string(flags, '|'), '') AS flags, len(list_filter(flags, lambda f: starts_with(f, 'lyrics_') OR starts_with(f, 'caption_'))) = 0 AS ok FROM fl",
    "flag_counts": f"WITH {_FLAGS} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM fl) GROUP BY 1",
    "crawl_coverage": " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE NOT {_b(f)}) AS n_filled, count(*) AS n_rows, round(count(*) FILTER (WHERE NOT {_b(f)})::DOUBLE / count(*), 6) AS share FROM track_crawl" for f in ("lyrics", "caption", "chord", "tempo", "music_key", "mbid", "isrc", "label", "country", "mb_release_date")),
    "crawl_sources": "SELECT e.key AS field, e.value AS source, count(*) AS n FROM (SELECT unnest(map_entries(sources)) AS e FROM track_crawl) GROUP BY 1, 2",
    "duplicate_lyrics": f"SELECT sha256(trim(lyrics, ' ' || chr(9) || chr(13) || chr(10))) AS digest, count(DISTINCT track_id) AS n_tracks FROM track_crawl WHERE NOT {_b('lyrics')} GROUP BY 1 HAVING count(DISTINCT track_id) > 1",
    "latest_crawl": "SELECT track_id, crawl_id, tempo, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY fetched_at DESC NULLS LAST, crawl_id DESC) AS p FROM track_crawl WHERE track_id IS NOT NULL) WHERE p = 1",
    "request_pairs": f"WITH {_PAIRS} SELECT * FROM rp",
    "user_profiles": f"""WITH {_PAIRS}, {_SDATE}, n AS (SELECT session_id, count(*) AS n FROM rp GROUP BY 1)
        SELECT user_id, count(*) AS n_sessions, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs, min(session_date) AS first_date, max(session_date) AS last_date FROM sd LEFT JOIN n ON n.session_id = sd.session_id GROUP BY 1""",
    "prior_sessions": f"""WITH {_SDATE}, dy AS (SELECT user_id, session_date, count(*) AS n FROM sd WHERE session_date IS NOT NULL GROUP BY 1, 2),
        b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_prior FROM dy)
        SELECT sd.session_id, sd.user_id, CAST(coalesce(b.n_prior, 0) AS BIGINT) AS n_prior FROM sd LEFT JOIN b ON b.user_id = sd.user_id AND b.session_date = sd.session_date""",
    "view_before_purchase": """WITH w AS (SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_ts FROM events)
        SELECT event_id, user_id, ts, prior_ts FROM w WHERE event_type = 'purchase'""",
    "expert_features": f"""WITH {_WIDE}, x AS (SELECT *, list_filter([rank_bm25, rank_popular], lambda v: v IS NOT NULL) AS r FROM ft)
        SELECT pair_id, track_id, CAST(rank_bm25 AS DOUBLE) AS rank_bm25, CAST(rank_popular AS DOUBLE) AS rank_popular, CAST(len(r) AS INT) AS hits, CAST(list_min(r) AS INT) AS rank_min, round(list_avg(r), 6) AS rank_mean,
               round(CASE WHEN len(r) > 1 THEN list_stddev_samp(r) ELSE 0 END, 6) AS rank_std, CAST(coalesce(list_max(r) - list_min(r), 0) AS INT) AS rank_span,
               CASE WHEN rank_bm25 = list_min(r) THEN 'bm25' WHEN rank_popular = list_min(r) THEN 'popular' ELSE '<none>' END AS best_pool, CAST(rank_bm25 - rank_popular AS DOUBLE) AS rank_gap, CAST(label AS INT) AS label FROM x""",
    "target_encoding": f"""WITH {_WIDE}, {_folds('ft')}, b AS (SELECT label, fold, CASE WHEN rank_bm25 IS NULL OR rank_bm25 <= 0 THEN 'missing' WHEN rank_bm25 <= 1 THEN 'r1' WHEN rank_bm25 <= 3 THEN 'r2_3' WHEN rank_bm25 <= 10 THEN 'r4_10'
            WHEN rank_bm25 <= 20 THEN 'r11_20' WHEN rank_bm25 <= 50 THEN 'r21_50' WHEN rank_bm25 <= 100 THEN 'r51_100' ELSE 'r101p' END AS bucket FROM ft JOIN fg ON fg.g = {_KEY}),
        g AS (SELECT bucket, fold, sum(label) AS y, count(*) AS n FROM b GROUP BY 1, 2), fo AS (SELECT fold, sum(y) AS y, sum(n) AS n FROM g GROUP BY 1),
        mu AS (SELECT fold, ((SELECT sum(y) FROM fo) - y)::DOUBLE / ((SELECT sum(n) FROM fo) - n) AS mu FROM fo),
        k AS (SELECT *, sum(y) OVER (PARTITION BY bucket) - y AS ky, sum(n) OVER (PARTITION BY bucket) - n AS kn FROM g)
        SELECT bucket, CAST(k.fold AS INT) AS fold, round((ky + 50.0::DOUBLE * mu) / (kn + 50.0::DOUBLE), 9) AS te, n FROM k JOIN mu ON mu.fold = k.fold""",
    "min_rank": f"WITH {_T} SELECT track_id, {_FIRST.format('artist_name')} AS artist, popularity, CAST(rank() OVER (PARTITION BY {_FIRST.format('artist_name')} ORDER BY popularity DESC NULLS LAST) AS INT) AS place FROM c2",
    "group_folds": f"WITH {_folds('train_pairs')} SELECT pair_id, CAST(fold AS INT) AS fold FROM train_pairs JOIN fg ON fg.g = {_KEY}",
    "bm25_negatives": f"""WITH c AS (SELECT DISTINCT pair_id, track_id AS positive, coalesce(seen, []) AS seen, unnest(bm25_top_tids) AS cand FROM train_pairs WHERE split = 'train'),
        o AS (SELECT pair_id, cand, row_number() OVER (PARTITION BY pair_id ORDER BY {_UNIT.format("'42|' || pair_id || '|' || cand")}, cand) AS slot FROM c WHERE cand IS NOT NULL AND cand IS DISTINCT FROM positive AND NOT list_contains(seen, cand))
        SELECT pair_id, cand AS track_id, CAST(slot AS INT) AS slot FROM o WHERE slot <= 4""",
    "artist_negatives": f"""WITH {_T}, a AS (SELECT track_id, {_FIRST.format('artist_name')} AS key FROM c2), nn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_UNIT.format("'42|' || track_id")}, track_id) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM a WHERE key IS NOT NULL),
        own AS (SELECT pair_id, p.track_id AS positive, key, n, CAST(floor({_UNIT.format("'42|' || pair_id")} * n) AS INT) AS st FROM train_pairs p JOIN nn ON nn.track_id = p.track_id WHERE split = 'train'),
        w AS (SELECT *, unnest(range(least(n, 5))) AS step FROM own),
        f AS (SELECT w.pair_id, nn.track_id, row_number() OVER (PARTITION BY w.pair_id ORDER BY step) AS slot FROM w JOIN nn ON nn.key = w.key AND nn.i = (w.st + w.step) % w.n WHERE nn.track_id <> w.positive)
        SELECT pair_id, track_id, CAST(slot AS INT) AS slot FROM f WHERE slot <= 4""",
    "dense_top10": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, sim, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""",
    "bm25_search": f"""WITH {_DOC}, w AS (SELECT track_id, regexp_extract_all(doc, '[a-z0-9][a-z0-9]+') AS w FROM docs), tot AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
        po AS (SELECT track_id, len, term, count(*) AS tf FROM (SELECT track_id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
        qt AS (SELECT DISTINCT pair_id, unnest(regexp_extract_all(lower(query), '[a-z0-9][a-z0-9]+')) AS term FROM train_pairs),
        sc AS (SELECT pair_id, track_id, round(CAST(sum(CAST(round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)), 9) AS DECIMAL(18,9))) AS DOUBLE), 6) AS score
               FROM qt JOIN po USING (term) JOIN df USING (term) CROSS JOIN tot GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, track_id) AS rank FROM sc) SELECT pair_id, track_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""",
    "weighted_fuse": f"""WITH {_RRF}, a AS (SELECT pair_id, track_id, rank + 1 AS r1, count(*) OVER (PARTITION BY pair_id) AS n FROM fr WHERE rank < 20), b AS (SELECT pair_id, track_id, rank + 1 AS r2 FROM rk WHERE pool = 'popular'),
        x AS (SELECT a.pair_id, a.track_id, r1, round(0.5::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + coalesce(r2, n + 1)), 12) AS score, 0.5::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + coalesce(r2, n + 1)) AS raw FROM a LEFT JOIN b ON a.pair_id = b.pair_id AND a.track_id = b.track_id)
        SELECT pair_id, track_id, score, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, r1) - 1 AS INT) AS rank FROM x""",
    "fold_mean": f"WITH {_POOLS} SELECT pair_id, 'tower' AS pool, track_id, round(avg(1.0::DOUBLE / (rank + 1)), 12) AS score, count(*) AS n_folds FROM rk GROUP BY 1, 3",
    "violations": f"""WITH {_RRF}, p AS (SELECT pair_id, list(track_id) AS ids FROM fr WHERE rank < 20 GROUP BY 1)
        SELECT 'too_long' AS rule, count(*) FILTER (WHERE len(ids) > 20) AS n FROM p UNION ALL SELECT 'repeated', count(*) FILTER (WHERE len(list_distinct(ids)) < len(ids)) FROM p
        UNION ALL SELECT 'blank_id', count(*) FILTER (WHERE len(list_filter(ids, lambda x: trim(x) = '')) > 0) FROM p
        UNION ALL SELECT 'no_list', 0 UNION ALL SELECT 'no_response', count(*) FILTER (WHERE pair_id % 2 <> 0) FROM p UNION ALL SELECT 'missing_field', 0 UNION ALL SELECT 'extra_field', 1
        UNION ALL SELECT 'unknown_track', count(DISTINCT pair_id) FROM fr WHERE rank < 20 AND track_id NOT IN (SELECT track_id FROM tracks WHERE track_id IS NOT NULL)""",
    "round_robin": "SELECT pair_id, coalesce(specificity, '') AS stratum, CAST(row_number() OVER (PARTITION BY coalesce(specificity, '') ORDER BY pair_id) AS INT) AS turn FROM train_pairs",
    "era_cues": f"WITH n AS (SELECT pair_id, {_eras('query')} AS e FROM train_pairs) SELECT pair_id, coalesce(array_to_string({_distinct('e')}, '|'), '') AS eras FROM n",
    "cited_titles": f"""WITH {_MSG}, t AS (SELECT DISTINCT session_id, turn_number, content, msg_id, unnest(regexp_extract_all(content, '"([^"]+)"', 1)) AS title FROM m WHERE speaker = 'assistant' AND content IS NOT NULL)
        SELECT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key, count(*) AS n, count(DISTINCT title) AS spellings FROM t GROUP BY 1""",
    "profile_keys": "SELECT " + " || '|' || ".join(f"coalesce(nullif(trim(user_profile.{f}), ''), 'unknown')" for f in ("age_group", "country_code", "gender", "preferred_language", "preferred_musical_culture")) + " AS key, count(*) AS n FROM sessions WHERE user_profile IS NOT NULL GROUP BY 1",
    "overused_words": f"""WITH {_MSG}, w AS (SELECT DISTINCT session_id, turn_number, content, msg_id, unnest(regexp_extract_all(lower(content), '[a-z0-9][a-z0-9]+')) AS word FROM m WHERE speaker = 'assistant' AND content IS NOT NULL)
        SELECT word, count(*) AS n FROM w WHERE length(word) >= 4 AND regexp_matches(word, '^[a-z]+$') AND word NOT IN ({_STOPS}) GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, word LIMIT 25""",
    "overused_bigrams": f"""WITH {_MSG}, w AS (SELECT session_id, turn_number, msg_id, list_filter(regexp_extract_all(lower(content), '[a-z0-9][a-z0-9]+'), lambda x: length(x) >= 4 AND regexp_matches(x, '^[a-z]+$') AND x NOT IN ({_STOPS})) AS w FROM m WHERE speaker = 'assistant' AND content IS NOT NULL),
        p AS (SELECT DISTINCT session_id, turn_number, msg_id, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1))
        SELECT bigram, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, bigram LIMIT 25""",
    "artist_overview": f"""WITH {_T}, y AS (SELECT {_FIRST.format('artist_name')} AS artist, CAST(year AS INT) AS year FROM c2),
        g AS (SELECT artist, count(*) AS n_tracks, min(year) AS y0, max(year) AS y1, list_sort(list(year) FILTER (WHERE year IS NOT NULL)) AS ys FROM y GROUP BY 1)
        SELECT artist, n_tracks, y0::DOUBLE AS first_year, y1::DOUBLE AS last_year, (ys[len(ys) // 2 + 1])::DOUBLE AS median_year FROM g""",
    "goal_progress_tail": """WITH p AS (SELECT DISTINCT session_id, g.turn_number AS turn_number, g.assessment AS assessment FROM (SELECT session_id, unnest(goal_progress_assessments) AS g FROM sessions)),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC, assessment DESC NULLS LAST) AS i FROM p) SELECT session_id, turn_number, assessment FROM r WHERE i <= 3 AND trim(assessment) <> ''""",
    "query_groups": f"""SELECT trim(query) AS q, count(DISTINCT doc_text) AS n_docs, count(DISTINCT {_KEY}) AS n_sessions, min(pair_id) AS first_pair FROM train_pairs WHERE trim(query) <> '' AND trim(doc_text) <> '' GROUP BY 1 HAVING count(DISTINCT doc_text) > 1""",
    "log_frequency": """WITH c AS (SELECT track_id, count(*) AS n FROM train_pairs WHERE split = 'train' AND track_id IS NOT NULL GROUP BY 1)
        SELECT track_id, round(ln((n + 1)::DOUBLE / ((SELECT sum(n) FROM c) + (SELECT count(*) FROM c))), 9) AS log_q FROM c""",
    "bucket_negatives": f"""WITH {_T}, a AS (SELECT track_id, 'p' || (pop // 10 * 10) || '-' || (pop // 10 * 10 + 9) AS key FROM c2), nn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_UNIT.format("'42|' || track_id")}, track_id) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM a WHERE key IS NOT NULL),
        own AS (SELECT pair_id, p.track_id AS positive, key, n, CAST(floor({_UNIT.format("'42|' || pair_id")} * n) AS INT) AS st FROM train_pairs p JOIN nn ON nn.track_id = p.track_id WHERE split = 'train'),
        w AS (SELECT *, unnest(range(least(n, 5))) AS step FROM own),
        f AS (SELECT w.pair_id, nn.track_id, row_number() OVER (PARTITION BY w.pair_id ORDER BY step) AS slot FROM w JOIN nn ON nn.key = w.key AND nn.i = (w.st + w.step) % w.n WHERE nn.track_id <> w.positive)
        SELECT pair_id, track_id, CAST(slot AS INT) AS slot FROM f WHERE slot <= 4""",
    "composed_queries": f"""WITH {_TURNS}, h AS (SELECT *, list_sort(list_distinct(flatten(coalesce(list(tracks) OVER w, [])))) AS seen FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        s AS (SELECT session_id, turn_number, query, seen FROM h WHERE query IS NOT NULL AND len(tracks) > 0), x AS (SELECT session_id, turn_number, unnest(seen) AS track_id, unnest(range(len(seen))) AS i FROM s),
        {_T}, l AS (SELECT session_id, turn_number, list('title: ' || lower(coalesce({_FIRST.format('track_name')}, 'unknown')) || ', artist: ' || lower(coalesce({_FIRST.format('artist_name')}, 'unknown')) ORDER BY i) AS ls FROM x JOIN c2 USING (track_id) GROUP BY 1, 2),
        f AS (SELECT s.session_id, s.turn_number, coalesce(ls, []) AS ls, array_to_string(coalesce(ls, []) || [lower(query)], chr(10)) AS txt FROM s LEFT JOIN l USING (session_id, turn_number))
        SELECT session_id, turn_number, CAST(len(ls) AS INT) AS n_lines, substring(sha256(txt), 1, 16) AS text_hash, CAST(trunc(length(txt) / 3.5::DOUBLE) AS INT) + 1 AS tokens FROM f""",
}
