"""SQL with the same rows as the further queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions.text import STOP_WORDS
from ..operators.features import NEGATIVE_SHARES
from ..operators.pools import TEXT_POOLS
from .oracles import _DOC, _FIRST, _KEY, _MSG, _PAIRS, _POPULARITY, _RRF, _SDATE, _T, _TURNS, _UNIT, _distinct, _eras, _fuse, _folds, _POOLS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FILLED = "nullif(trim({0}), '')"
_JOINED = "nullif(array_to_string(list_transform(list_filter({0}, lambda x: x IS NOT NULL AND x <> ''), lambda x: trim(x)), '{1}'), '')"
_ONE = "nullif(trim({0}[1]), '')"
_YEAR = "nullif(regexp_extract(coalesce(release_date, ''), '^(\\d{4})', 1), '')"
_ERA = "CASE WHEN CAST(year AS INT) % 10 <= 3 THEN 'early ' WHEN CAST(year AS INT) % 10 <= 6 THEN 'mid ' ELSE 'late ' END || (CAST(year AS INT) // 10 * 10) || 's'"
_BPM = "CASE WHEN TRY_CAST(trim(tempo) AS DOUBLE) BETWEEN -1e9 AND 1e9 THEN TRY_CAST(trim(tempo) AS DOUBLE) END"
_PACE = "CASE WHEN {0} < 70 THEN 'slow' WHEN {0} < 110 THEN 'mid-tempo' WHEN {0} < 140 THEN 'upbeat' WHEN {0} IS NOT NULL THEN 'fast' END"

# Tags with their number of tracks, and the fold that drops tags contained in others.
_FREQ = f"""{_T}, freq AS (SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(plain, lambda y: y <> ''))) AS tag FROM c2) GROUP BY 1),
 own AS (SELECT track_id, list({{'t': tag, 'n': n}} ORDER BY i) AS xs FROM (SELECT track_id, unnest(tags) AS tag, unnest(range(len(tags))) AS i FROM c2) JOIN freq USING (tag) GROUP BY 1),
 c3 AS (SELECT c2.*, coalesce(xs, []) AS xs FROM c2 LEFT JOIN own USING (track_id))"""
_MEET = "(contains(k.t, b[1].t) OR contains(b[1].t, k.t))"
_FOLD = f"""list_reduce(list_transform(ys, lambda x: [x]), lambda acc, b: CASE WHEN len(list_filter(acc, lambda k: {_MEET} AND NOT (b[1].n > k.n OR (b[1].n = k.n AND length(b[1].t) > length(k.t))))) > 0
    THEN acc ELSE list_concat(list_filter(acc, lambda k: NOT {_MEET}), b) END)"""
_KEPT = f"""{_FREQ}, c4 AS (SELECT *, list_filter(xs, lambda x: x.n >= 5) AS ys FROM c3), c5 AS (SELECT *, CASE WHEN len(ys) = 0 THEN [] ELSE list_transform({_FOLD}, lambda x: x.t) END AS kept FROM c4)"""
_TOP3 = "list_transform(list_sort(list_transform(CASE WHEN len(ys) = 0 THEN [] ELSE {0} END, lambda x: {{'m': -x.n, 't': x.t}})), lambda x: x.t)[1:3]"

_CRAWL = "cr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY fetched_at DESC NULLS LAST, crawl_id DESC) AS p FROM track_crawl WHERE track_id IS NOT NULL) WHERE p = 1)"
_ALIAS = "nullif(trim(regexp_replace(lower(trim({0})), '\\s+', ' ', 'g'), '.,;:!?\"''`-'), '')"
_ALIASES = f"list_filter([{_ALIAS.format('title')}, {_ALIAS.format('artist')}, {_ALIAS.format('album')}], lambda x: x IS NOT NULL)"
_PROSE = f"""{_FREQ}, {_CRAWL}, p1 AS (SELECT c3.track_id, {_ONE.format('track_name')} AS title, {_JOINED.format('artist_name', ', ')} AS artist, {_JOINED.format('album_name', ', ')} AS album, year, pop,
    coalesce(list_filter(list_transform(mb_tags, lambda x: trim(x)), lambda x: x <> '')[1], {_ONE.format('tag_list')}) AS genre, {_FILLED.format('label')} AS label, {_FILLED.format('country')} AS country, {_BPM} AS bpm,
    {_FILLED.format('music_key')} AS mkey, list_transform(list_filter(xs, lambda x: x.n >= 2), lambda x: x.t)[1:15] AS shown FROM c3 LEFT JOIN (SELECT track_id, mb_tags, label, country, tempo, music_key FROM cr) AS x USING (track_id)),
 p2 AS (SELECT *, nullif(concat_ws(' ', nullif(concat_ws(' ', '"' || title || '"', 'by ' || artist), ''), '(' || nullif(concat_ws(', ', year, genre), '') || ')'), '') AS head,
    nullif(concat_ws(', ', country, nullif(concat_ws(' ', {_ERA}, genre), '')), '') AS place, {_distinct(_ALIASES)} AS aliases FROM p1),
 p3 AS (SELECT track_id, concat_ws(chr(10), head || '.', CASE WHEN label IS NOT NULL THEN concat_ws(', ', 'From ' || album, CASE WHEN album IS NULL THEN 'Released on ' ELSE 'released on ' END || label || coalesce(' (' || place || ')', ''))
      WHEN album IS NOT NULL THEN 'From ' || album || coalesce(' (' || place || ')', '') ELSE 'Released ' || place END || '.',
    'Also known as: ' || nullif(array_to_string(aliases, ' | '), '') || '.', 'Notable tags: ' || nullif(array_to_string(shown, ', '), '') || '.',
    nullif(concat_ws('. ', 'Tempo: ' || CAST(round_even(bpm, 0) AS BIGINT) || ' BPM (' || {_PACE.format('bpm')} || ')', 'Key: ' || mkey), '') || '.', 'Popularity: ' || {_POPULARITY} || ' (' || pop || '/100).') AS doc FROM p2)"""

_CATEGORIES = "CASE upper(trim({0})) WHEN 'A' THEN 'sonic characteristics' WHEN 'B' THEN 'lyrical themes' WHEN 'C' THEN 'album artwork' WHEN 'D' THEN 'activity fit' WHEN 'E' THEN 'guided discovery' WHEN 'F' THEN 'vague memory' WHEN 'G' THEN 'mood and emotion' WHEN 'H' THEN 'artist exploration' WHEN 'I' THEN 'exact popular hit' WHEN 'J' THEN 'popular trends' WHEN 'K' THEN 'era sound' END"
_PHRASE = """CASE upper(trim(coalesce(s, ''))) WHEN 'HH' THEN 'wants a specific ' || category || ' track' WHEN 'HL' THEN 'wants tracks matching a specific ' || category || ' angle'
    WHEN 'LH' THEN 'trying to recall a particular track from a vague ' || category || ' sense' WHEN 'LL' THEN 'exploring various ' || category || ' tracks' ELSE 'interested in ' || category || ' tracks' END"""
_GOALS = f"""g0 AS (SELECT session_id, max(conversation_goal.category) AS c, max(conversation_goal.specificity) AS s, max(conversation_goal.listener_goal) AS g FROM sessions GROUP BY 1),
 g1 AS (SELECT *, {_eras('g')} AS e, {_CATEGORIES.format('c')} AS category, lower(coalesce(g, '')) AS low FROM g0),
 goals AS (SELECT session_id, {_distinct('e')} AS goal_eras,
    CASE WHEN regexp_matches(low, '\\b(?:top|biggest|#1|number\\s+one|chart[- ]?topping|smash\\s+hit|mega[- ]?hit|huge\\s+hit|massive\\s+hit)\\b') THEN 'top-tier' WHEN regexp_matches(low, '\\b(?:popular|mainstream|famous|well[- ]?known)\\b') THEN 'popular'
         WHEN regexp_matches(low, '\\b(?:obscure|hidden\\s+gem|underrated|underground|lesser[- ]?known|under\\s+the\\s+radar|deep\\s+cut|niche)\\b') THEN 'obscure' END AS goal_pop,
    CASE WHEN regexp_matches(low, '\\b(?:right\\s+now|nowadays|these\\s+days|this\\s+(?:week|month|year)|recent(?:ly)?|latest|brand[- ]?new|trending|currently)\\b') THEN 'present'
         WHEN regexp_matches(low, '\\b(?:classic|oldies|vintage|retro|throwback|nostalgic|nostalgia|old[- ]?school|yesteryear)\\b') THEN 'classic' END AS goal_time,
    {_PHRASE} AS phrase, category, nullif(concat_ws(', ', 'category: ' || {_FILLED.format('c')}, 'specificity: ' || {_FILLED.format('s')}, 'listener_goal: ' || {_FILLED.format('g')}), '') AS line FROM g1)"""


def _body(dropped: set[str]) -> str:
    recent = "recent[1:1]" if "recent_first" in dropped else "(CASE WHEN len(recent) > 2 THEN [recent[1], recent[len(recent)]] ELSE recent END)" if "recent_middle" in dropped else "recent"
    context = [c for name, c in (("goal", "phrase"), ("aggregates", "aggregates"), ("cues", "mined")) if name not in dropped]
    told = f"nullif(concat_ws('. ', {', '.join(context)}), '')" if context else "NULL::VARCHAR"
    return f"concat_ws(chr(10), 'Recent listens: ' || nullif(array_to_string({recent}, '; '), '') || '.', 'Context: ' || {told} || '.', wish)"


_DROPS = ("aggregates", "recent_middle", "cues", "goal", "recent_first")
_BODIES = [_body(set(_DROPS[:k])) for k in range(len(_DROPS) + 1)]
_TOKENS = "CAST(trunc(length({0}) / 3.5::DOUBLE) AS INT) + 1"
_LISTED = "'{0}' || nullif(array_to_string({1}, ', '), '')"
_QUERY_TEXT = f"""{_TURNS}, {_KEPT}, {_GOALS},
 f AS (SELECT track_id, nullif(concat_ws(' ', nullif(concat_ws(' ', '"' || {_ONE.format('track_name')} || '"', 'by ' || {_ONE.format('artist_name')}), ''), '(' || nullif(concat_ws(', ', year, {_ONE.format('tag_list')}), '') || ')'), '') AS line,
    (CAST(year AS INT) // 10 * 10) || 's' AS decade, pop, kept[1:20] AS kept FROM c5),
 asked AS (SELECT session_id, turn_number, query FROM t WHERE query IS NOT NULL), plays AS (SELECT session_id, turn_number AS pt, unnest(tracks) AS track_id, unnest(range(len(tracks))) AS i FROM t),
 h AS (SELECT asked.session_id, asked.turn_number, list(line ORDER BY pt DESC, i DESC) AS lines, list(decade) FILTER (WHERE decade IS NOT NULL) AS decades, list_sort(list(pop) FILTER (WHERE pop IS NOT NULL)) AS pops, flatten(list(kept ORDER BY pt, i)) AS all_tags
    FROM asked JOIN plays ON plays.session_id = asked.session_id AND plays.pt < asked.turn_number JOIN f USING (track_id) GROUP BY 1, 2),
 q1 AS (SELECT asked.*, coalesce(list_filter(lines[1:5], lambda x: x IS NOT NULL), []) AS recent, CASE WHEN list_min(decades) = list_max(decades) THEN list_min(decades) ELSE list_min(decades) || '-' || list_max(decades) END AS era,
    pops[len(pops) // 2 + 1] AS pop, coalesce({_distinct('all_tags')}, [])[1:8] AS tags, goal_eras, goal_pop, goal_time, phrase, category FROM asked LEFT JOIN h USING (session_id, turn_number) LEFT JOIN goals USING (session_id)),
 q2 AS (SELECT session_id, turn_number, recent, phrase, nullif(concat_ws('; ', 'era ' || era, {_POPULARITY}, {_LISTED.format('tags: ', 'tags')}), '') AS aggregates,
    nullif(concat_ws('; ', {_LISTED.format('era cue: ', 'goal_eras')}, 'popularity cue: ' || goal_pop, 'time cue: ' || goal_time), '') AS mined, 'Looking for: ' || coalesce(nullif(trim(lower(query)), ''), '(no current message)') || coalesce(' — ' || category, '') AS wish FROM q1),
 q3 AS (SELECT session_id, turn_number, {', '.join(f'{b} AS b{i}' for i, b in enumerate(_BODIES))} FROM q2),
 q4 AS (SELECT session_id, turn_number, CASE {' '.join(f"WHEN {_TOKENS.format(f'b{i}')} <= 90 THEN b{i}" for i in range(len(_BODIES)))} ELSE right(b{len(_BODIES) - 1}, 315) END AS text FROM q3)"""

# Evaluation by session and turn.
_STRATA = """s0 AS (SELECT session_id, regexp_replace(lower(trim(max(user_profile.user_split))), '^test_', '') AS sp, upper(trim(max(conversation_goal.specificity))) AS spec, upper(trim(max(conversation_goal.category))) AS cat FROM sessions GROUP BY 1),
 st AS (SELECT lower(replace(session_id, '-', '')) AS session_id, CASE WHEN sp IN ('warm', 'cold', 'train') THEN sp ELSE 'unknown' END AS split, CASE WHEN spec IN ('HH', 'HL', 'LH', 'LL') THEN spec ELSE 'unknown' END AS specificity,
    CASE WHEN regexp_matches(cat, '^[A-K]$') THEN cat ELSE 'unknown' END AS category FROM s0)"""
_PREDICTIONS = f"""{_RRF}, {_MSG}, {_STRATA}, tr AS (SELECT lower(replace(session_id, '-', '')) AS session_id, turn_number, arg_min(content, msg_id) FILTER (WHERE speaker = 'assistant' AND content IS NOT NULL) AS response FROM m GROUP BY 1, 2),
 f1 AS (SELECT {_KEY} AS session_id, turn_number, min(pair_id) AS pair_id, arg_min(coalesce(truth, ''), pair_id) AS tru FROM q WHERE session_id IS NOT NULL AND turn_number IS NOT NULL GROUP BY 1, 2),
 ls AS (SELECT pair_id, list(track_id ORDER BY rank) AS ids FROM fr WHERE rank < 20 GROUP BY 1),
 pr AS (SELECT f1.session_id, f1.turn_number, ids, response, split, specificity, category, CASE WHEN f1.pair_id % 7 <> 0 AND tru <> '' THEN tru END AS truth
    FROM f1 JOIN ls USING (pair_id) LEFT JOIN tr ON tr.session_id = f1.session_id AND tr.turn_number = f1.turn_number LEFT JOIN st ON st.session_id = f1.session_id)"""


def _report(labels: str) -> str:
    cuts = [f"coalesce(round(avg(CASE WHEN truth IS NOT NULL THEN CASE WHEN hit BETWEEN 1 AND {k} THEN 1 / log2(hit + 1) ELSE 0 END END), 6), 0) AS ndcg_{k}" for k in (1, 10, 20)]
    cuts += [f"coalesce(round(avg(CASE WHEN truth IS NOT NULL THEN CASE WHEN hit BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END END), 6), 0)::DOUBLE AS recall_{k}" for k in (20, 100)]
    return f"""WITH {_PREDICTIONS}, lb AS (SELECT *, {labels} AS names FROM pr), tn AS (SELECT *, unnest(names || list_transform(names, lambda x: CASE WHEN x = 'overall' THEN 'T' || turn_number ELSE x || '/T' || turn_number END)) AS label FROM lb),
        e AS (SELECT *, coalesce(list_position(ids, truth), 0) AS hit FROM tn), r AS (SELECT label, {', '.join(cuts)}, count(truth) AS matched, max(len(ids)) AS max_pred_len FROM e GROUP BY 1),
        sh AS (SELECT label, count(DISTINCT t) AS shown FROM (SELECT label, unnest(ids) AS t FROM e WHERE truth IS NOT NULL) GROUP BY 1),
        w AS (SELECT label, list_filter(string_split_regex(lower(coalesce(response, '')), '\\s+'), lambda x: x <> '') AS w FROM e WHERE truth IS NOT NULL), bg AS (SELECT label, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)),
        lx AS (SELECT label, count(DISTINCT (a, b))::DOUBLE / count(*) AS lexical FROM bg GROUP BY 1)
        SELECT r.label, ndcg_1, ndcg_10, ndcg_20, recall_20, recall_100, coalesce(round(shown::DOUBLE / (SELECT count(DISTINCT track_id) FROM tracks), 6), 0) AS catalog_div, coalesce(round(lexical, 6), 0) AS lexical_div, matched, CAST(max_pred_len AS INT) AS max_pred_len
        FROM r LEFT JOIN sh ON sh.label = r.label LEFT JOIN lx ON lx.label = r.label"""


# Pools.
_Q = """pq AS (SELECT pair_id AS query_id, query, coalesce(seen, []) AS seen, upper(trim(specificity)) AS specificity FROM train_pairs WHERE pair_id % 100 = 0),
 seen AS (SELECT DISTINCT query_id, unnest(seen) AS track_id FROM pq)"""
_EVERY_Q = _Q.replace(" WHERE pair_id % 100 = 0", "")
_TERM = "[a-z0-9][a-z0-9]+"


def _field(name: str) -> str:
    if name == "noun_tags":
        every = f"concat_ws(' ', {', '.join(_JOINED.format(c, ' ') for c in ('track_name', 'artist_name', 'album_name'))})"
        return f"array_to_string(list_filter(regexp_extract_all(lower({every}), '[a-z]{{3,}}'), lambda w: w NOT IN ({_STOPS})), ' ')"
    if name == "tag_list_raw":
        return _JOINED.format("tag_list", " ")
    if name == "tag_list_clean":
        return "array_to_string(stags, ' ')"
    if name in ("track_name", "artist_name", "album_name", "mb_tags"):
        return _JOINED.format(name, ", ")
    return name


def _text_pool(name: str, n: int, a: str, queries: str = "pq") -> str:
    """CTEs that end in {a} (query_id, track_id, rank, score)."""
    lines = ", ".join(f"'{f}: ' || nullif(trim({_field(f)}), '')" for f in TEXT_POOLS[name])
    return f"""{a}_d AS (SELECT track_id, regexp_extract_all(lower(concat_ws(chr(10), {lines})), '{_TERM}') AS w FROM c2 LEFT JOIN (SELECT * EXCLUDE (track_name, artist_name, album_name, duration) FROM cr) AS x USING (track_id)),
 {a}_t AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {a}_d), {a}_p AS (SELECT track_id, len, term, count(*) AS tf FROM (SELECT track_id, len(w) AS len, unnest(w) AS term FROM {a}_d) GROUP BY 1, 2, 3), {a}_f AS (SELECT term, count(*) AS df FROM {a}_p GROUP BY 1),
 {a}_l AS (SELECT query_id, string_agg(line, chr(10) ORDER BY i) AS lines FROM (SELECT query_id, unnest(seen) AS track_id, unnest(range(len(seen))) AS i FROM {queries}) JOIN (SELECT track_id, concat_ws(' ', {_FIRST.format('track_name')}, {_FIRST.format('artist_name')}, {_FIRST.format('album_name')}) AS line FROM c2) USING (track_id) GROUP BY 1),
 {a}_q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(concat_ws(chr(10), lines, query)), '{_TERM}')) AS term FROM {queries} LEFT JOIN {a}_l USING (query_id)),
 {a}_s AS (SELECT query_id, track_id, round(CAST(sum(CAST(round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)), 9) AS DECIMAL(18,9))) AS DOUBLE), 6) AS score
    FROM {a}_q JOIN {a}_p USING (term) JOIN {a}_f USING (term) CROSS JOIN {a}_t GROUP BY 1, 2), {_cut(a + '_s', n, a)}"""


def _cut(source: str, n: int, a: str) -> str:
    return f"{a} AS (SELECT * FROM (SELECT query_id, track_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id) - 1 AS rank FROM {source} AS z ANTI JOIN seen ON seen.query_id = z.query_id AND seen.track_id = z.track_id) WHERE rank < {n})"


def _popular_pool(n: int, a: str, queries: str = "pq") -> str:
    return f"""{a}_c AS (SELECT track_id, count(*)::DOUBLE AS score FROM train_pairs WHERE split = 'train' AND track_id IS NOT NULL GROUP BY 1), {a}_s AS (SELECT query_id, track_id, score FROM {queries} CROSS JOIN {a}_c), {_cut(a + '_s', n, a)}"""


def _ensemble(parts: dict[str, str], n: int, a: str, value: str = "1.0::DOUBLE / (61 + rank)") -> str:
    union = " UNION ALL ".join(f"SELECT query_id, track_id, rank, {i} AS o, '{name}' AS pool FROM {part}" for i, (name, part) in enumerate(parts.items()))
    return f"""{a}_u AS ({union}), {a}_g AS (SELECT query_id, track_id, round(CAST(sum(CAST({value} AS DECIMAL(20,15))) AS DOUBLE), 12) AS fused, min(o * 100000 + rank) AS first, count(DISTINCT pool) AS pools, min(rank) AS best FROM {a}_u GROUP BY 1, 2),
 {a} AS (SELECT query_id, track_id, rank, 1.0::DOUBLE / (rank + 1) AS score, fused, pools, best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first, track_id) - 1 AS rank FROM {a}_g) WHERE rank < {n})"""


_OUT = "SELECT query_id, track_id, CAST(rank AS INT) AS rank, score FROM"
_BASE, _EVERY = f"{_T}, {_CRAWL}, {_Q}", f"{_T}, {_CRAWL}, {_EVERY_Q}"
_CF = "v AS (SELECT track_id, min(vector) AS vector FROM track_vectors WHERE vector_type = 'cf-bpr' AND track_id IS NOT NULL AND len(vector) = 128 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1)"
_META = "vm AS (SELECT track_id, min(vector) AS vector FROM track_vectors WHERE vector_type = 'metadata-qwen3_embedding_0.6b' AND track_id IS NOT NULL AND len(vector) = 1024 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1)"
_COS = "round(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 6)"

# Histories.
_HIST = f"""{_PAIRS}, {_SDATE}, hs AS (SELECT sd.* FROM sd WHERE session_id IN (SELECT session_id FROM rp)), hp AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(session_date, ''), session_id) AS place FROM hs),
 hi AS (SELECT user_id, hp.session_id, session_date, place, turn_number, utterance, track_id FROM hp JOIN rp ON rp.session_id = hp.session_id)"""


def _before(strict: bool) -> str:
    date = "hi.session_date < sd.session_date" if strict else "hi.session_date IS NULL OR hi.session_date <= sd.session_date"
    return f"{_HIST}, bf AS (SELECT sd.session_id AS target, hi.* FROM sd JOIN hi ON hi.user_id = sd.user_id AND hi.session_id <> sd.session_id WHERE sd.session_date IS NULL OR coalesce({date}, false))"


_WANTED = "wa AS (SELECT session_id AS target, vector FROM (SELECT session_id, content AS track_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_number, msg_id, content) AS p FROM m WHERE speaker = 'music' AND content IS NOT NULL) JOIN v USING (track_id) WHERE p = 1)"


def _keyed(name: str, own: str, tracks: str, k: int, ident: str = "pair_id") -> str:
    """k numbered tracks of the same key: own (ident, positive, key), tracks (track_id, key)."""
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_UNIT.format("'42|' || track_id")}, track_id) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM {tracks} WHERE key IS NOT NULL),
 {name}_o AS (SELECT o.{ident}, o.positive, o.key, x.n, CAST(floor({_UNIT.format(f"'42|' || o.{ident}")} * x.n) AS INT) AS st FROM {own} o JOIN (SELECT DISTINCT key, n FROM {name}_n) x ON x.key = o.key),
 {name}_w AS (SELECT *, unnest(range(least(n, {k + 1}))) AS step FROM {name}_o),
 {name} AS (SELECT {ident}, track_id, slot FROM (SELECT w.{ident}, z.track_id, row_number() OVER (PARTITION BY w.{ident} ORDER BY step) AS slot FROM {name}_w w JOIN {name}_n z ON z.key = w.key AND z.i = (w.st + w.step) % w.n WHERE z.track_id <> w.positive) WHERE slot <= {k})"""


_WAYS = " ".join(f"WHEN '{spec}' THEN [{', '.join(f'''{{'way': '{w}', 'p': {p}::DOUBLE}}''' for w, p in ways if w != 'off')}]" for spec, ways in NEGATIVE_SHARES.items() if ways[0][0] != "off")


def _picks(k: int) -> str:
    """CTEs k0 ... kN: one more pick each."""
    out = ["k0 AS (SELECT pair_id, offers, ways, [] :: STRUCT(slot INT, way VARCHAR, track_id VARCHAR)[] AS picks FROM mix)"]
    for s in range(1, k + 1):
        u = _UNIT.format(f"'42|' || pair_id || '|{s}'")
        drawn = f"coalesce(list_filter(list_transform(range(1, len(ways) + 1), lambda i: CASE WHEN {u} * total < list_sum(list_transform(ways[1:i], lambda x: x.p)) THEN ways[i].way END), lambda x: x IS NOT NULL)[1], ways[len(ways)].way)"
        out.append(f"k{s}a AS (SELECT *, list_sum(list_transform(ways, lambda x: x.p)) AS total FROM k{s - 1})")
        out.append(f"k{s}b AS (SELECT *, {drawn} AS drawn, list_filter(offers, lambda o: NOT list_contains(list_transform(picks, lambda p: p.track_id), o.track_id)) AS freed FROM k{s}a)")
        out.append(f"k{s}c AS (SELECT *, list_sort(list_transform(freed, lambda o: {{'first': CASE WHEN o.way = drawn THEN 0 ELSE 1 END, 'm': -list_filter(ways, lambda x: x.way = o.way)[1].p, 'i': list_position(list_transform(ways, lambda x: x.way), o.way), 'slot': o.slot, 't': o.track_id, 'way': o.way}})) AS line FROM (SELECT * REPLACE (list_filter(freed, lambda o: list_contains(list_transform(ways, lambda x: x.way), o.way)) AS freed) FROM k{s}b))")
        out.append(f"k{s} AS (SELECT pair_id, offers, ways, CASE WHEN len(line) > 0 THEN list_append(picks, {{'slot': {s}::INT, 'way': line[1].way, 'track_id': line[1].t}}) ELSE picks END AS picks FROM k{s}c)")
    return ", ".join(out)


_OFFERED = f"""{_MSG}, {_T}, pl AS (SELECT session_id, content AS track_id, min((turn_number, msg_id)) AS since FROM m WHERE speaker = 'music' AND content IS NOT NULL GROUP BY 1, 2),
 ix AS (SELECT session_id, track_id, row_number() OVER (PARTITION BY session_id ORDER BY since) AS idx FROM pl),
 off AS (SELECT session_id, idx, {_FIRST.format('track_name')} AS pool_title, {_FIRST.format('artist_name')} AS artist, {_FIRST.format('album_name')} AS album, year FROM ix JOIN c2 USING (track_id) WHERE {_FIRST.format('track_name')} IS NOT NULL),
 rep AS (SELECT session_id, turn_number, arg_min(content, msg_id) FILTER (WHERE speaker = 'assistant' AND content IS NOT NULL) AS reply, arg_min(content, msg_id) FILTER (WHERE speaker = 'user' AND content IS NOT NULL) AS query FROM m GROUP BY 1, 2)"""
_CITED = " || ".join(f"regexp_extract_all(reply, '{a}([^{a}{b}]+){b}', 1)" for a, b in (('"', '"'), ("“", "”"), ("«", "»"), ("‘", "’")))
_TKEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_POSITION = "CASE WHEN turn_number <= 1 THEN 'first' WHEN turn_number >= 8 THEN 'final' ELSE 'mid' END"
_SPEC = "coalesce(upper(trim(specificity)), 'unknown')"
_DEMOS = f"dm AS (SELECT pair_id, {_SPEC} AS specificity, {_POSITION} AS turn, source AS category, round({_UNIT.format(chr(39) + 'demo|' + chr(39) + ' || pair_id')}, 6) AS score FROM train_pairs WHERE split = 'train')"
_LAYER = [("w.specificity = d.specificity AND w.turn = d.turn AND w.category = d.category", "w.specificity, w.turn, w.category"), ("w.specificity = d.specificity AND w.turn = d.turn", ""), ("w.specificity = d.specificity", ""), ("true", "")]
_NOTE = "(length(greatest_) > length(least_) AND starts_with(greatest_, least_) AND substring(greatest_, length(least_) + 1, 1) IN (' ', '(', '[', '-', '/'))"
_NAME = "trim(regexp_replace(lower(coalesce({0}, '')), '[\\s\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


def _alike(a: str, b: str) -> str:
    longer, shorter = f"CASE WHEN length({a}) > length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) > length({b}) THEN {b} ELSE {a} END"
    return f"({a} = '' OR {b} = '' OR {a} = {b} OR {_NOTE.replace('greatest_', '(' + longer + ')').replace('least_', '(' + shorter + ')')})"


_CE = [_UNIT.format(f"'ce{i}|' || pair_id || '|' || track_id") for i in (0, 1, 2, 9)]
_REPLY = f"{_MSG}, rep AS (SELECT session_id, turn_number, arg_min(content, msg_id) FILTER (WHERE speaker = 'assistant' AND content IS NOT NULL) AS reply FROM m GROUP BY 1, 2)"

MORE_ORACLES = {
    "kept_tags": f"""WITH {_KEPT} SELECT track_id, coalesce(array_to_string(kept[1:20], '|'), '') AS tags, coalesce(array_to_string(list_transform(list_filter(xs, lambda x: x.n >= 2), lambda x: x.t)[1:15], '|'), '') AS doc_tags,
        coalesce(array_to_string({_TOP3.format(_FOLD)}, '|'), '') AS top_tags FROM c5""",
    "track_prose": f"WITH {_PROSE} SELECT track_id, doc FROM p3",
    "goal_cues": f"WITH {_GOALS} SELECT session_id, coalesce(array_to_string(goal_eras, '|'), '') AS eras, goal_pop AS popularity, goal_time AS time, phrase, category, line FROM goals",
    "query_texts": f"WITH {_QUERY_TEXT} SELECT session_id, turn_number, text, {_TOKENS.format('text')} AS tokens FROM q4",
    "recommended_lists": f"""WITH {_RRF}, {_T}, l AS (SELECT pair_id, rank, concat_ws(' ', concat_ws(' ', (rank + 1) || '. ' || coalesce({_FIRST.format('track_name')}, 'unknown') || ' — ' || coalesce({_FIRST.format('artist_name')}, 'unknown'), '(' || nullif(concat_ws(', ', {_FIRST.format('album_name')}, year), '') || ')'),
        '[' || nullif(array_to_string(tags[1:8], ', '), '') || ']') AS line FROM fr JOIN c2 USING (track_id) WHERE rank < 5) SELECT pair_id, string_agg(line, chr(10) ORDER BY rank) AS lines FROM l GROUP BY 1""",
    "profile_lines": """WITH p AS (SELECT session_id, min(user_profile) AS p FROM sessions WHERE user_profile IS NOT NULL GROUP BY 1)
        SELECT session_id, nullif(concat_ws(', ', 'age: ' || coalesce(CAST(p.age AS VARCHAR), nullif(trim(p.age_group), '')), 'gender: ' || nullif(trim(p.gender), ''), 'country_name: ' || nullif(trim(p.country_name), ''), 'preferred_language: ' || nullif(trim(p.preferred_language), ''),
            'preferred_musical_culture: ' || nullif(trim(p.preferred_musical_culture), '')), '') AS line,
        concat_ws(', ', """ + ", ".join(f"'{f}: ' || coalesce(nullif(trim(p.{f}), ''), 'unknown')" for f in ("age_group", "country_code", "gender", "preferred_language", "preferred_musical_culture")) + ") AS prompt FROM p",
    "chat_tails": f"""WITH {_MSG}, {_T}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC, msg_id DESC) AS i FROM m WHERE speaker IS NOT NULL AND content IS NOT NULL) WHERE i <= 10),
        l AS (SELECT k.session_id, i, speaker || ': ' || CASE WHEN speaker = 'music' THEN coalesce({_FIRST.format('track_name')}, content) ELSE content END AS line FROM k LEFT JOIN c2 ON c2.track_id = k.content)
        SELECT session_id, count(*) AS n, substring(sha256(string_agg(line, chr(10) ORDER BY i DESC)), 1, 16) AS digest FROM l GROUP BY 1""",
    "event_scores": """WITH k AS (SELECT event_type, coalesce(least(greatest(TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT), 1), 5), 1) AS k FROM events)
        SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, round(avg(((k - 1) / 4.0::DOUBLE + 0.5) / 2), 6) AS mean FROM k GROUP BY 1""",
    "eval_report": _report("list_filter(['overall', CASE WHEN split IN ('warm', 'cold') THEN split END, CASE WHEN specificity <> 'unknown' THEN specificity END, CASE WHEN category <> 'unknown' THEN category END], lambda x: x IS NOT NULL)"),
    "eval_filtered": _report("CASE WHEN split = 'warm' AND specificity = 'HH' THEN ['warm+HH'] ELSE [] END"),
    "retrieval_summary": f"""WITH {_RRF}, {_STRATA}, k AS (SELECT DISTINCT {_KEY} AS session_id, turn_number, truth FROM q WHERE session_id IS NOT NULL AND turn_number IS NOT NULL AND truth IS NOT NULL),
        f1 AS (SELECT {_KEY} AS session_id, turn_number, min(pair_id) AS pair_id FROM q WHERE session_id IS NOT NULL AND turn_number IS NOT NULL AND truth IS NOT NULL GROUP BY 1, 2),
        hits AS (SELECT k.session_id, k.turn_number, fr.rank FROM k JOIN f1 USING (session_id, turn_number) JOIN fr ON fr.pair_id = f1.pair_id AND fr.track_id = k.truth AND fr.rank < 20),
        sz AS (SELECT session_id, turn_number, count(*) AS n FROM k GROUP BY 1, 2), h AS (SELECT session_id, turn_number, count(*) AS hits, sum(1 / log2(rank + 2)) AS dcg, min(rank) AS best FROM hits GROUP BY 1, 2),
        sc AS (SELECT sz.turn_number::DOUBLE AS turn_number, specificity, category, coalesce(hits, 0)::DOUBLE / n AS recall, coalesce(hits, 0)::DOUBLE / least(n, 20) AS recall_capped, coalesce(1.0::DOUBLE / (best + 1), 0) AS mrr,
            coalesce(dcg, 0) / list_sum(list_transform(range(least(n, 20)), lambda i: 1 / log2(i + 2))) AS ndcg FROM sz LEFT JOIN h USING (session_id, turn_number) LEFT JOIN st USING (session_id))
        SELECT turn_number, specificity, category, count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(recall_capped), 6) AS recall_capped, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr
        FROM sc GROUP BY GROUPING SETS ((), (turn_number), (specificity), (category), (turn_number, specificity))""",
    "pool_popular": f"WITH {_BASE}, {_popular_pool(20, 'a')} {_OUT} a",
    "pool_bm25": f"WITH {_EVERY}, {_text_pool('bm25_simple', 20, 'a')}, {_text_pool('bm25_tags_crawl_kw', 20, 'b')}, {_ensemble({'x': 'a', 'y': 'b'}, 20, 'c_')} {_OUT} c_",
    "pool_weighted": f"WITH {_EVERY}, {_text_pool('bm25_music_only', 20, 'a')}, {_popular_pool(20, 'b')}, {_ensemble({'bm25_music_only': 'a', 'popular': 'b'}, 20, 'c_', chr(40) + 'CASE WHEN o = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * pow(0.9::DOUBLE, rank))')} {_OUT} c_",
    "pool_reranked": f"""WITH {_BASE}, {_text_pool('bm25_music_only', 20, 'a')}, {_popular_pool(20, 'b')}, {_ensemble({'x': 'a', 'y': 'b'}, 20, 'c_')},
        z AS (SELECT query_id, track_id, row_number() OVER (PARTITION BY query_id ORDER BY pools + 1.0::DOUBLE / (best + 2) DESC, rank) - 1 AS rank FROM c_) SELECT query_id, track_id, CAST(rank AS INT) AS rank, 1.0::DOUBLE / (rank + 1) AS score FROM z""",
    "predict_routed": f"""WITH {_EVERY}, go AS (SELECT *, len(seen) = 0 AND coalesce(specificity IN ('HH', 'HL'), false) AS fresh FROM pq), qm AS (SELECT * FROM go WHERE NOT fresh), qf AS (SELECT * FROM go WHERE fresh),
        {_text_pool('bm25_music_only', 20, 'a', 'qm')}, {_popular_pool(20, 'b', 'qm')}, {_ensemble({'x': 'a', 'y': 'b'}, 20, 'c_')}, {_popular_pool(20, 'f_', 'qf')}
        SELECT query_id, track_id, CAST(rank AS INT) AS rank, fused AS score FROM c_ WHERE rank < 10 UNION ALL SELECT query_id, track_id, CAST(rank AS INT), score FROM f_ WHERE rank < 10""",
    "predict_rewritten": f"""WITH {_BASE}, qr AS (SELECT query_id, CASE WHEN query_id % 200 = 0 THEN coalesce(substring(query, 1, 40), query) ELSE query END AS query, seen FROM pq), {_text_pool('bm25_music_only', 20, 'a', 'qr')}, {_text_pool('bm25_simple', 20, 'b')},
        {_ensemble({'x': 'a', 'y': 'b'}, 20, 'c_')} SELECT query_id, track_id, CAST(rank AS INT) AS rank, fused AS score FROM c_ WHERE rank < 10""",
    "pool_qemb_cf": f"""WITH {_Q}, {_CF}, he AS (SELECT DISTINCT query_id, track_id FROM seen), pt AS (SELECT query_id, unnest(list_transform(vector, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(vector, lambda y: y::DOUBLE * y::DOUBLE))))) AS x, unnest(range(128)) AS i FROM he JOIN v USING (track_id)),
        mn AS (SELECT query_id, list(x::FLOAT ORDER BY i) AS vector FROM (SELECT query_id, i, avg(x) AS x FROM pt GROUP BY 1, 2) GROUP BY 1), s AS (SELECT mn.query_id, v.track_id, {_COS.format('mn.vector', 'v.vector')} AS score FROM mn CROSS JOIN v), {_cut('s', 20, 'a')} {_OUT} a""",
    "histories": f"WITH {_HIST} SELECT user_id, session_id, session_date, CAST(place AS INT) AS place, turn_number, utterance, track_id FROM hi",
    "history_records": f"""WITH {_HIST} SELECT user_id, count(DISTINCT session_id) AS n_sessions, count(*) AS n_turns, substring(sha256(string_agg(track_id, '|' ORDER BY place, turn_number, utterance, track_id)), 1, 16) AS tracks FROM hi GROUP BY 1""",
    "user_lookup": f"""WITH {_HIST}, k AS (SELECT user_id, arg_min(user_profile, session_id) AS p FROM sessions WHERE trim(coalesce(user_id, '')) <> '' AND user_profile IS NOT NULL GROUP BY 1), n AS (SELECT user_id, count(DISTINCT session_id) AS n_sessions, count(*) AS n_turns FROM hi GROUP BY 1)
        SELECT coalesce(k.user_id, n.user_id) AS user_id, p.age_group AS age_group, coalesce(n_sessions, 0) AS n_sessions, coalesce(n_turns, 0) AS n_turns FROM k FULL JOIN n ON n.user_id = k.user_id""",
    "history_before": f"WITH {_before(True)} SELECT target, count(*) AS n_pairs, count(DISTINCT session_id) AS n_sessions FROM bf GROUP BY 1",
    "history_same_day": f"WITH {_before(False)} SELECT target, count(*) AS n_pairs, count(DISTINCT session_id) AS n_sessions FROM bf GROUP BY 1",
    "first_pairs": f"""WITH {_before(True)}, n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY place, turn_number, track_id) AS n FROM bf WHERE contains(lower(utterance), 'song')) SELECT target, CAST(n AS INT) AS n, track_id, substring(sha256(utterance), 1, 16) AS said FROM n WHERE n <= 5""",
    "latest_pairs": f"WITH {_before(True)}, n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY place DESC, turn_number DESC, track_id DESC) AS n FROM bf) SELECT target, CAST(n AS INT) AS n, track_id FROM n WHERE n <= 3",
    "scored_pairs": f"""WITH {_before(True)}, {_CF}, {_WANTED}, sim AS (SELECT bf.*, {_COS.format('v.vector', 'wa.vector')} AS sim FROM bf JOIN v USING (track_id) JOIN wa USING (target)),
        n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sim DESC, place, turn_number, track_id) AS n FROM sim WHERE sim >= 0.05) SELECT target, CAST(n AS INT) AS n, track_id, sim, CASE WHEN sim >= 0.65 THEN 'strong' WHEN sim >= 0.45 THEN 'moderate' ELSE 'weak' END AS label FROM n WHERE n <= 5""",
    "relevant_priors": f"""WITH {_before(True)}, {_CF}, {_META}, cd AS (SELECT DISTINCT session_id AS target, content AS candidate FROM m WHERE speaker = 'music' AND content IS NOT NULL), bo AS (SELECT DISTINCT bf.target, track_id, candidate FROM bf JOIN cd USING (target))
        SELECT DISTINCT target, bo.track_id FROM bo JOIN v ON v.track_id = bo.track_id JOIN v w ON w.track_id = candidate WHERE {_COS.format('v.vector', 'w.vector')} >= 0.3
        UNION SELECT target, bo.track_id FROM bo JOIN vm ON vm.track_id = bo.track_id JOIN vm w ON w.track_id = candidate WHERE {_COS.format('vm.vector', 'w.vector')} >= 0.55""",
    "negative_mixture": f"""WITH {_T}, tk AS (SELECT track_id, {_FIRST.format('artist_name')} AS artist, {_FIRST.format('album_name')} AS album, tags[1:3] AS tags, 'p' || (pop // 10 * 10) || '-' || (pop // 10 * 10 + 9) AS bucket FROM c2),
        ps AS (SELECT * FROM train_pairs WHERE split = 'train'), {", ".join(f"t_{c} AS (SELECT track_id, {c} AS key FROM tk WHERE {c} IS NOT NULL), o_{c} AS (SELECT pair_id, track_id AS positive, key FROM ps JOIN t_{c} USING (track_id)), {_keyed('n_' + c, 'o_' + c, 't_' + c, 10)}" for c in ("artist", "album", "bucket"))},
        t_tag AS (SELECT track_id, unnest(list_distinct(coalesce(tags, []))) AS key FROM tk), o_tag AS (SELECT pair_id || '|' || unnest(range(len(track_top_tags[1:3]))) AS pid, track_id AS positive, unnest(track_top_tags[1:3]) AS key FROM ps), {_keyed('n_tag', 'o_tag', 't_tag', 10, 'pid')},
        b0 AS (SELECT DISTINCT pair_id, track_id AS positive, coalesce(seen, []) AS seen, unnest(bm25_top_tids) AS cand FROM ps),
        b1 AS (SELECT pair_id, cand AS track_id, row_number() OVER (PARTITION BY pair_id ORDER BY {_UNIT.format("'42|' || pair_id || '|' || cand")}, cand) AS slot FROM b0 WHERE cand IS NOT NULL AND cand IS DISTINCT FROM positive AND NOT list_contains(seen, cand)),
        al AS (SELECT pair_id, 'same-artist' AS way, track_id, slot FROM n_artist UNION ALL SELECT pair_id, 'same-album', track_id, slot FROM n_album UNION ALL SELECT pair_id, 'same-pop-bucket', track_id, slot FROM n_bucket UNION ALL SELECT pair_id, 'bm25-topk', track_id, slot FROM b1 WHERE slot <= 10
            UNION ALL SELECT CAST(split_part(pid, '|', 1) AS BIGINT), 'same-tag', track_id, min(CAST(split_part(pid, '|', 2) AS INT) * 10 + slot) FROM n_tag GROUP BY 1, 3),
        fr AS (SELECT al.*, upper(trim(specificity)) AS spec FROM al JOIN ps ON ps.pair_id = al.pair_id WHERE NOT list_contains(coalesce(seen, []), al.track_id) AND al.track_id <> ps.track_id),
        mix AS (SELECT * FROM (SELECT pair_id, list({{'way': way, 'slot': slot, 'track_id': track_id}}) AS offers, CASE spec {_WAYS} ELSE [] END AS ways FROM fr GROUP BY pair_id, spec) WHERE len(ways) > 0), {_picks(4)}
        SELECT pair_id, p.slot AS slot, p.way AS way, p.track_id AS track_id FROM (SELECT pair_id, unnest(picks) AS p FROM k4)""",
    "oof_features": f"""WITH {_RRF}, {_folds('q')}, x AS (SELECT fr.pair_id, q.turn_number, fold, count(*) AS n, max(CASE WHEN fr.track_id = q.truth THEN 1 ELSE 0 END) AS hit FROM fr JOIN q ON q.pair_id = fr.pair_id JOIN fg ON fg.g = {_KEY} WHERE rank < 20 GROUP BY 1, 2, 3)
        SELECT turn_number, CAST(fold AS INT) AS fold, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS largest, round(avg(hit), 6) AS coverage FROM x GROUP BY 1, 2""",
    "ce_ranks": f"""WITH {_RRF}, t AS (SELECT pair_id, track_id, rank, round({_CE[0]}, 6) AS f0, round({_CE[1]}, 6) AS f1, round({_CE[2]}, 6) AS f2, {_CE[3]} < 0.7 AS has FROM fr WHERE rank < 20), m AS (SELECT *, CASE WHEN has THEN round((f0 + f1 + f2) / 3, 6) END AS ce_mean FROM t),
        r AS (SELECT *, rank() OVER (PARTITION BY pair_id ORDER BY ce_mean DESC NULLS LAST) AS ce_rank, row_number() OVER (PARTITION BY pair_id ORDER BY CASE WHEN rank < 10 THEN 0 ELSE 1 END, CASE WHEN rank < 10 THEN -ce_mean END NULLS LAST, rank) - 1 AS again FROM m)
        SELECT pair_id, track_id, ce_mean, CASE WHEN has THEN round(sqrt(((f0 - ce_mean) ** 2 + (f1 - ce_mean) ** 2 + (f2 - ce_mean) ** 2) / 2), 4) END AS ce_std, CAST(ce_rank AS INT) AS ce_rank, CAST(again AS INT) AS rank FROM r""",
    "encoding_state": f"""WITH {_RRF}, p AS (SELECT pair_id, track_id, min(rank + 1) AS r FROM rk WHERE pool = 'popular' GROUP BY 1, 2), x AS (SELECT CASE WHEN fr.track_id = q.truth THEN 1 ELSE 0 END AS y,
            CASE WHEN r IS NULL OR r <= 0 THEN 'missing' WHEN r <= 1 THEN 'r1' WHEN r <= 3 THEN 'r2_3' WHEN r <= 10 THEN 'r4_10' WHEN r <= 20 THEN 'r11_20' WHEN r <= 50 THEN 'r21_50' WHEN r <= 100 THEN 'r51_100' ELSE 'r101p' END AS bucket
            FROM fr JOIN q ON q.pair_id = fr.pair_id LEFT JOIN p ON p.pair_id = fr.pair_id AND p.track_id = fr.track_id WHERE fr.rank < 20)
        SELECT bucket, round((sum(y) + 50.0::DOUBLE * (SELECT avg(y) FROM x)) / (count(*) + 50.0::DOUBLE), 9) AS te FROM x GROUP BY 1""",
    "validation_split": f"SELECT pair_id, coalesce({_UNIT.format(chr(39) + '42|' + chr(39) + ' || ' + _KEY)} < 0.2, false) AS is_validation FROM train_pairs",
    "cited_tracks": f"""WITH {_OFFERED}, ct AS (SELECT session_id, turn_number, {_CITED} AS ts FROM rep WHERE reply IS NOT NULL), cd AS (SELECT session_id, turn_number, {_distinct('ts')} AS ts FROM ct), c9 AS (SELECT session_id, turn_number, unnest(ts) AS title, unnest(range(len(ts))) AS place FROM cd),
        fo AS (SELECT session_id, {_TKEY.format('pool_title')} AS key, min(idx) AS idx FROM off GROUP BY 1, 2)
        SELECT c9.session_id, c9.turn_number, CAST(place AS INT) AS place, CAST(fo.idx AS INT) AS idx, '"' || off.pool_title || '"' || coalesce(' by ' || nullif(off.artist, ''), '') AS canonical
        FROM c9 JOIN fo ON fo.session_id = c9.session_id AND fo.key = {_TKEY.format('title')} AND fo.key <> '' JOIN off ON off.session_id = fo.session_id AND off.idx = fo.idx""",
    "track_anchors": f"""WITH {_OFFERED}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id, artist) AS n, count(*) OVER (PARTITION BY session_id, artist, year) AS y, count(*) OVER (PARTITION BY session_id, artist, album) AS a, row_number() OVER (PARTITION BY session_id, artist ORDER BY idx) AS i FROM off WHERE artist IS NOT NULL)
        SELECT session_id, CAST(idx AS INT) AS idx, artist || CASE WHEN n = 1 THEN '' WHEN year IS NOT NULL AND y = 1 THEN ' (' || year || ')' WHEN album IS NOT NULL AND a = 1 THEN ' (from ' || album || ')' ELSE ' (track ' || i || ')' END AS anchor FROM n""",
    "match_checks": f"""WITH x AS (SELECT crawl_id, lyrics_match AS lm, {_NAME.format('lyrics_match.track_name')} AS t1, {_NAME.format('track_name')} AS t2, {_NAME.format('lyrics_match.artist_name')} AS a1, {_NAME.format('artist_name')} AS a2,
            CASE WHEN duration > 1000 THEN duration / 1000.0::DOUBLE WHEN duration > 0 THEN duration::DOUBLE END AS want FROM track_crawl WHERE lyrics_match IS NOT NULL)
        SELECT crawl_id, round(abs(lm.duration - want), 3) AS apart, coalesce(lm.method IN ('lrclib_search', 'genius_search'), false) AS fuzzy, {_alike('t1', 't2')} AS title_alike, {_alike('a1', 'a2')} AS artist_alike FROM x""",
    "demo_fallback": f"""WITH {_DEMOS}, w AS (SELECT pair_id AS wanted, {_SPEC} AS specificity, {_POSITION} AS turn, source AS category FROM train_pairs WHERE split <> 'train'),
        f AS ({" UNION ALL ".join(f"SELECT w.wanted, d.pair_id, d.score, {i} AS level FROM w JOIN dm d ON {test}" for i, (test, _) in enumerate(_LAYER))}), o AS (SELECT wanted, pair_id, min(level) AS level, max(score) AS score FROM f GROUP BY 1, 2)
        SELECT wanted, pair_id, CAST(level AS INT) AS level, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY level, score DESC, pair_id) AS place FROM o) WHERE place <= 3""",
    "demo_coverage": f"""WITH {_DEMOS}, b AS (SELECT pair_id, concat_ws('|', specificity, coalesce(category, 'unknown'), turn) AS bucket, score FROM dm), r AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS n, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, pair_id) AS i FROM b)
        SELECT pair_id, bucket, score, CASE WHEN i <= 1 THEN 1 ELSE 2 END AS pass FROM r ORDER BY CASE WHEN i <= 1 THEN 0 ELSE 1 END, CASE WHEN i <= 1 THEN -n END, CASE WHEN i <= 1 THEN bucket END, score DESC, pair_id LIMIT 40""",
    "demo_buckets": f"WITH {_DEMOS} SELECT specificity, turn, count(*) AS n FROM dm GROUP BY 1, 2",
    "blended_neighbors": """WITH s AS (SELECT a.vec_id AS query_id, a.label AS own, b.vec_id, b.label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s), x AS (SELECT query_id, vec_id, round(0.6::DOUBLE * sim + 0.4::DOUBLE * ((vec_id % 37) - (SELECT min(vec_id % 37) FROM embeddings))::DOUBLE / ((SELECT max(vec_id % 37) FROM embeddings) - (SELECT min(vec_id % 37) FROM embeddings)) + CASE WHEN label = own THEN 0.05::DOUBLE ELSE 0 END, 6) AS blended FROM r WHERE rank <= 20)
        SELECT query_id, vec_id, blended, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, vec_id) AS place FROM x) WHERE place <= 5""",
    "capped_groups": f"""WITH {_RRF}, {_T}, x AS (SELECT pair_id, fr.track_id, rank, coalesce({_FIRST.format('artist_name')}, 'unknown') AS artist FROM fr JOIN c2 USING (track_id) WHERE rank < 20), g AS (SELECT pair_id, artist, row_number() OVER (PARTITION BY pair_id ORDER BY count(*) DESC, min(rank), artist) AS r FROM x GROUP BY 1, 2)
        SELECT x.pair_id, x.track_id, CASE WHEN r <= 2 THEN x.artist ELSE 'discovery' END AS kept_group FROM x JOIN g ON g.pair_id = x.pair_id AND g.artist = x.artist""",
    "sampled_pairs": f"SELECT pair_id FROM train_pairs ORDER BY {_UNIT.format(chr(39) + '42|' + chr(39) + ' || pair_id')}, CAST(pair_id AS VARCHAR) LIMIT 50",
    "run_consistency": "SELECT 1 AS run, count(*) FILTER (WHERE pair_id % 10 = 0) AS missing, 0 AS extra FROM train_pairs UNION ALL SELECT 2, 0, count(*) FROM train_pairs",
    "score_summary": """WITH e AS (SELECT 'value' AS score, value AS x FROM events WHERE value IS NOT NULL UNION ALL SELECT 'other', value % 7 FROM events WHERE value IS NOT NULL), p AS (SELECT score, CAST(round_even(x, 0) AS INT) AS v, count(*) AS n, sum(x) AS s FROM e GROUP BY 1, 2)
        SELECT score, round(sum(s) / sum(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS n, string_agg(v || ':' || n, '|' ORDER BY v) AS histogram FROM p GROUP BY 1""",
    "nearest_pool": f"""WITH {_CF}, p AS (SELECT pair_id, track_id FROM train_pairs WHERE pair_id % 100 = 0 AND track_id IS NOT NULL), s AS (SELECT p.pair_id, w.track_id, row_number() OVER (PARTITION BY p.pair_id ORDER BY {_COS.format('v.vector', 'w.vector')} DESC, w.track_id) AS r FROM p JOIN v ON v.track_id = p.track_id CROSS JOIN v w),
        u AS (SELECT pair_id, track_id, 0 AS part, 0 AS r FROM p UNION ALL SELECT pair_id, track_id, 1, r FROM s WHERE r <= 21), o AS (SELECT pair_id, track_id, min(part * 1000 + r) AS since FROM u GROUP BY 1, 2)
        SELECT pair_id, CAST(place AS INT) AS place, track_id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY since, track_id) - 1 AS place FROM o) WHERE place < 20""",
    "intents": f"""WITH {_CF}, p AS (SELECT pair_id, track_id, seen, bm25_top_tids FROM train_pairs WHERE pair_id % 100 = 0), cd AS (SELECT * FROM (SELECT DISTINCT pair_id, unnest(bm25_top_tids) AS track_id FROM p) WHERE track_id IS NOT NULL), cv AS (SELECT cd.*, vector AS cvec FROM cd LEFT JOIN v USING (track_id)),
        q AS (SELECT DISTINCT pair_id FROM p JOIN v ON v.track_id = p.track_id), nq AS (SELECT cv.pair_id, cv.track_id FROM cv JOIN p ON p.pair_id = cv.pair_id JOIN v ON v.track_id = p.track_id WHERE {_COS.format('cvec', 'v.vector')} >= 0.3),
        hd AS (SELECT DISTINCT pair_id, unnest(seen) AS t FROM p), np AS (SELECT DISTINCT cv.pair_id, cv.track_id FROM cv JOIN hd ON hd.pair_id = cv.pair_id JOIN v ON v.track_id = hd.t WHERE {_COS.format('cvec', 'v.vector')} >= 0.2),
        ng AS (SELECT DISTINCT a.pair_id, a.track_id FROM cv a JOIN cv b ON b.pair_id = a.pair_id AND a.track_id <> b.track_id WHERE {_COS.format('a.cvec', 'b.cvec')} >= 0.15)
        SELECT pair_id, track_id, CASE WHEN (pair_id, track_id) IN (SELECT (pair_id, track_id) FROM nq) THEN 'query' WHEN (pair_id, track_id) IN (SELECT (pair_id, track_id) FROM np) THEN 'taste' WHEN (pair_id, track_id) IN (SELECT (pair_id, track_id) FROM ng) THEN 'group' ELSE 'discovery' END AS intent FROM cd""",
    "first_turns": f"SELECT pair_id, turn_number FROM train_pairs WHERE session_id IS NOT NULL ORDER BY {_KEY}, turn_number NULLS FIRST, pair_id LIMIT 100",
    "track_overview": f"""WITH {_MSG}, {_T}, x AS (SELECT DISTINCT session_id, content AS track_id FROM m WHERE speaker = 'music'), r AS (SELECT session_id, {_FIRST.format('artist_name')} AS artist, {_FIRST.format('album_name')} AS album, CAST(year AS INT) AS year, tags[1:10] AS tags FROM x JOIN c2 USING (track_id)),
        o AS (SELECT session_id, count(*) AS n_tracks, count(DISTINCT artist) AS n_artists, count(DISTINCT album) AS n_albums, list_sort(list(year) FILTER (WHERE year IS NOT NULL)) AS ys FROM r GROUP BY 1),
        a AS (SELECT session_id, string_agg(artist, '|' ORDER BY i) AS top_artist FROM (SELECT session_id, artist, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, artist) AS i FROM r WHERE artist IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2) WHERE i <= 3 GROUP BY 1),
        g AS (SELECT session_id, string_agg(tag, '|' ORDER BY i) AS top_tag FROM (SELECT session_id, tag, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, tag) AS i FROM (SELECT session_id, unnest(tags) AS tag FROM r) GROUP BY 1, 2) WHERE i <= 5 GROUP BY 1)
        SELECT o.session_id, n_tracks, n_artists, n_albums, ys[1]::DOUBLE AS first_year, ys[len(ys)]::DOUBLE AS last_year, ys[len(ys) // 2 + 1]::DOUBLE AS median_year, top_artist, top_tag FROM o LEFT JOIN a ON a.session_id = o.session_id LEFT JOIN g ON g.session_id = o.session_id""",
    "novelty": f"""WITH {_REPLY}, x AS (SELECT session_id, turn_number, list_distinct(list_filter(regexp_extract_all(lower(reply), '{_TERM}'), lambda y: length(y) >= 4 AND y NOT IN ({_STOPS}))) AS w, len(list_filter(string_split_regex(reply, '\\s+'), lambda y: y <> '')) AS n_words,
            {_UNIT.format("'half|' || session_id || '|' || turn_number")} < 0.5 AS known FROM rep WHERE reply IS NOT NULL), k AS (SELECT DISTINCT unnest(w) AS word FROM x WHERE known), e AS (SELECT session_id, turn_number, unnest(w) AS word FROM x WHERE NOT known),
        c AS (SELECT session_id, turn_number, count(*) AS n, count(k.word) AS old FROM e LEFT JOIN k ON k.word = e.word GROUP BY 1, 2), f AS (SELECT x.session_id, x.turn_number, n_words, CASE WHEN coalesce(n, 0) = 0 THEN 1.0::DOUBLE ELSE (n - old)::DOUBLE / n END AS fresh FROM x LEFT JOIN c ON c.session_id = x.session_id AND c.turn_number = x.turn_number WHERE NOT known)
        SELECT session_id, turn_number, round(fresh, 6) AS novelty, round(CASE WHEN n_words BETWEEN 5 AND 120 THEN 0.7::DOUBLE * 0.5 + 0.3::DOUBLE * fresh ELSE 0 END, 6) AS blended FROM f""",
    "vector_dims": "SELECT vector_type, count(DISTINCT track_id) AS n, CAST(max(len(vector)) AS INT) AS dimension FROM (SELECT vector_type, track_id, min(vector) AS vector FROM track_vectors WHERE track_id IS NOT NULL AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1, 2) GROUP BY 1",
    "batch_vectors": f"WITH {_CF}, p AS (SELECT pair_id, unnest(bm25_top_tids) AS track_id, unnest(range(len(bm25_top_tids))) AS place FROM train_pairs) SELECT pair_id, CAST(place AS INT) AS place, vector IS NOT NULL AS found, round(vector[1]::DOUBLE, 6) AS x FROM p LEFT JOIN v ON v.track_id = p.track_id",
    "user_vectors": "WITH u AS (SELECT user_id, min(user_profile) AS p FROM sessions WHERE trim(coalesce(user_id, '')) <> '' AND user_profile IS NOT NULL GROUP BY 1), k AS (SELECT user_id, " + " || '|' || ".join(f"coalesce(nullif(trim(p.{f}), ''), 'unknown')" for f in ("age_group", "country_code", "gender", "preferred_language", "preferred_musical_culture")) + """ AS key FROM u),
        z AS (SELECT key, count(*) AS n_users FROM k GROUP BY 1), a AS (SELECT DISTINCT user_id FROM messages WHERE trim(coalesce(user_id, '')) <> '') SELECT a.user_id, k.key, n_users FROM a LEFT JOIN k ON k.user_id = a.user_id LEFT JOIN z ON z.key = k.key""",
    "filled_profiles": "WITH r AS (SELECT * FROM sessions WHERE trim(coalesce(user_id, '')) <> ''), w AS (SELECT user_id, arg_min(user_profile, session_id) FILTER (WHERE user_profile IS NOT NULL) AS p, " + ", ".join(f"arg_min(user_profile.{f}, session_id) FILTER (WHERE trim(user_profile.{f}) <> '') AS o_{f}" for f in ("age_group", "country_code", "gender")) + " FROM r GROUP BY 1) SELECT user_id, " + ", ".join(f"coalesce(nullif(trim(p.{f}), ''), o_{f}) AS {f}" for f in ("age_group", "country_code", "gender")) + " FROM w",
    "crawl_upsert": """WITH c AS (SELECT crawl_id, track_id, tempo, ok, crawl_id % 2 AS half FROM track_crawl WHERE track_id IS NOT NULL) SELECT crawl_id, track_id, tempo, ok FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY half DESC, crawl_id DESC) AS p FROM c) WHERE p = 1""",
    "crawl_union": f"WITH {_CRAWL} SELECT track_id, strlen(lyrics) AS n_bytes FROM cr",
    "query_cache": """WITH p AS (SELECT pair_id, split, substring(sha256(trim(query)), 1, 16) AS key FROM train_pairs WHERE trim(query) <> '') SELECT key, min(pair_id) AS pair_id, count(*) AS n FROM p WHERE split <> 'train' AND key NOT IN (SELECT key FROM p WHERE split = 'train') GROUP BY 1""",
    "all_turns": f"SELECT split, turn_number, count(DISTINCT {_KEY}) AS n_sessions FROM train_pairs WHERE session_id IS NOT NULL AND turn_number IS NOT NULL GROUP BY 1, 2",
    "contiguous_turns": f"""WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_number) AS n FROM t WHERE query IS NOT NULL AND len(tracks) > 0 AND turn_number >= 1) SELECT session_id, count(*) AS n_turns, max(tracks[1]) AS some_track FROM n WHERE n = turn_number GROUP BY 1""",
}
#: Text pools that are asked every pair.
_EVERY_POOLS = ("bm25_crawl_lyrics", "bm25_simple", "bm25_tags_crawl_kw",)
MORE_ORACLES |= {f"pool_{name}": f"WITH {_EVERY if name in _EVERY_POOLS else _BASE}, {_text_pool(name, 20, 'a')} {_OUT} a" for name in TEXT_POOLS if name != "bm25_history_noun_tags"}
