"""DuckDB SQL that gives the rows of the registered queries, written apart from them."""

from __future__ import annotations

# The wording that prompts must have, stated here so that a change of it there shows.
_ASK_HOUR = "Describe in two or three sentences what these entries show was worked on."
_ASK_DAY = "Write four paragraphs about the day: its subjects, where attention held and broke, its course, and a conclusion."
_ASK_CHAT = "Answer from the log above alone; where it says nothing, say that."
_HOUR_TOKENS, _DAY_TOKENS, _CHAT_TOKENS = 300, 1200, 800
_QUESTION = "What took the longest?"

_ACT = r"""
act AS (
  SELECT CAST(e.user_id % 4 AS INTEGER) AS stream, CAST(e.ts AS DATE) AS date, e.event_id AS seq, epoch_us(e.ts) // 1000 AS ms, e.user_id,
    CASE e.event_type WHEN 'view' THEN 'applicationActivated' WHEN 'click' THEN 'windowChanged' WHEN 'purchase' THEN 'urlChanged' WHEN 'signup' THEN 'privacyBoundary' WHEN 'error' THEN 'sessionLocked' END AS kind,
    'app_' || (e.user_id % 3) AS app, 'title ' || (k % 5) AS title, p.url AS url, 'doc' || (k % 7) || '.txt' AS document, k % 29 = 0 AS sensitive, k, e.event_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
  LEFT JOIN pages p ON e.event_type = 'purchase' AND p.page_id = e.event_id % (SELECT greatest(count(*), 1) FROM pages)
)"""
_ROWS = _ACT + r""",
rel AS (SELECT *, kind = 'sessionLocked' AS away, coalesce(sensitive, FALSE) OR kind = 'privacyBoundary' AS private FROM act WHERE kind IN ('applicationActivated', 'windowChanged', 'urlChanged', 'privacyBoundary', 'sessionLocked')),
l AS (SELECT *, lag(away) OVER w AS la, lag(private) OVER w AS lp, lag(app) OVER w AS lapp, lag(ms) OVER w AS lms, lead(ms) OVER w AS nms, lead(away) OVER w AS na FROM rel WINDOW w AS (PARTITION BY stream, date ORDER BY seq)),
s AS (SELECT *, CASE WHEN NOT away AND (lms IS NULL OR la OR ms - lms > 900000 OR lapp <> app OR lp <> private) THEN 1 ELSE 0 END AS st, nms IS NULL OR (NOT na AND nms - ms > 900000) AS idle FROM l),
m AS (SELECT *, sum(st) OVER (PARTITION BY stream, date ORDER BY seq) AS ep, CASE WHEN idle THEN 0 ELSE least(greatest(nms - ms, 0), 300000) END AS credit, CASE WHEN idle THEN ms ELSE nms END AS until FROM s),
r AS (SELECT * FROM m WHERE NOT away),
g AS (SELECT stream, date, ep, arg_min(app, seq) AS app, bool_or(private) AS is_private, arg_min(ms, seq) AS start_ms, arg_max(until, seq) AS end_ms, CAST(sum(credit) AS BIGINT) AS active_ms, count(*) AS event_count FROM r GROUP BY ALL),
e AS (SELECT stream, ep, date AS day, CAST(date AS VARCHAR) AS date, CAST(date AS VARCHAR) || '#' || start_ms AS id, app, start_ms, end_ms, end_ms - start_ms AS duration_ms, active_ms, event_count, is_private FROM g)"""
_TITLE = r""",
cur AS (SELECT *, last_value(CASE WHEN NOT private AND trim(title) <> '' THEN title END IGNORE NULLS) OVER (PARTITION BY stream, date, ep ORDER BY seq ROWS UNBOUNDED PRECEDING) AS current FROM r),
held AS (SELECT stream, date, ep, current, sum(credit) AS total, min(seq) AS first FROM cur WHERE current IS NOT NULL GROUP BY ALL),
ht AS (SELECT stream, date, ep, current AS title FROM held QUALIFY row_number() OVER (PARTITION BY stream, date, ep ORDER BY total DESC, first DESC) = 1)"""


def _ordered(name: str, value: str, most: int | None = None) -> str:
    cap = f"WHERE n <= {most}" if most else ""
    return f""",
{name} AS (SELECT stream, date, ep, string_agg(v, '|' ORDER BY first) AS v, list(v ORDER BY first) AS vs FROM (
  SELECT *, row_number() OVER (PARTITION BY stream, date, ep ORDER BY first) AS n FROM (SELECT stream, date, ep, {value} AS v, min(seq) AS first FROM r WHERE NOT private AND {value} IS NOT NULL GROUP BY ALL)) {cap} GROUP BY ALL)"""


_TITLES = _ordered("tl", "title")
_DOCS = _ordered("dl", "document", 8)
_URLS = _ordered("ul", "url")
_TEXT = r""",
vl AS (SELECT stream, date, ep, string_agg(v, '|' ORDER BY first) AS v, list(v ORDER BY first) AS vs FROM (
  SELECT *, row_number() OVER (PARTITION BY stream, date, ep ORDER BY first) AS n FROM (
    SELECT stream, date, ep, v, min(place) AS first FROM (SELECT stream, date, ep, 'line ' || (k % 11) AS v, seq * 2 AS place FROM r WHERE NOT private UNION ALL SELECT stream, date, ep, 'status bar', seq * 2 + 1 FROM r WHERE NOT private) GROUP BY ALL)) WHERE n <= 36 GROUP BY ALL)"""
_SLICES = r""",
x AS (SELECT *, unnest(generate_series(start_ms // 3600000, greatest((end_ms - 1) // 3600000, start_ms // 3600000))) AS h FROM e),
y AS (SELECT *, CAST(h - start_ms // 3600000 AS INTEGER) AS pos, CAST(h % 24 AS INTEGER) AS hour, CASE WHEN end_ms = start_ms THEN active_ms ELSE active_ms * (least((h + 1) * 3600000, end_ms) - greatest(h * 3600000, start_ms)) // (end_ms - start_ms) END AS share FROM x),
sl AS (SELECT stream, date, id, app, ep, start_ms, hour, pos, CAST(share + CASE WHEN pos = 0 THEN active_ms - sum(share) OVER (PARTITION BY stream, date, ep) ELSE 0 END AS BIGINT) AS share_ms FROM y),
hr AS (SELECT stream, date, hour, CAST(sum(share_ms) AS BIGINT) AS active_ms, count(*) AS slices FROM sl GROUP BY ALL),
hap AS (SELECT *, CAST(row_number() OVER (PARTITION BY stream, date, hour ORDER BY active_ms DESC, app) AS INTEGER) AS rank FROM (SELECT stream, date, hour, app, CAST(sum(share_ms) AS BIGINT) AS active_ms, count(*) AS episodes FROM sl GROUP BY ALL))"""
_DAYS = r""",
dy AS (SELECT stream, date, CAST(sum(active_ms) AS BIGINT) AS active_ms, CAST(sum(greatest(duration_ms - active_ms, 0)) AS BIGINT) AS idle_ms, count(*) AS episodes, count(*) FILTER (is_private) AS private_episodes, min(start_ms) AS first_ms, max(end_ms) AS last_ms,
  CAST(sum(active_ms) + sum(greatest(duration_ms - active_ms, 0)) AS BIGINT) AS screen_ms FROM e GROUP BY ALL),
us AS (SELECT *, CAST(row_number() OVER (PARTITION BY stream, date ORDER BY active_ms DESC, app) AS INTEGER) AS rank FROM (SELECT stream, date, app, CAST(sum(active_ms) AS BIGINT) AS active_ms, count(*) AS episodes FROM e GROUP BY ALL))"""
_SUMS = r""",
su AS (SELECT hr.stream, hr.date, hr.hour, greatest(hr.active_ms - (hr.hour % 4) * 40000, 0) AS active_ms, '  Mostly ' || hap.app || '.' || chr(10) AS text, 'model-a' AS model FROM hr JOIN hap USING (stream, date, hour) WHERE hr.hour % 3 <> 0 AND hap.rank = 1),
da AS (SELECT stream, date, ' A day of ' || episodes || ' sessions. ' AS daily FROM dy WHERE day(CAST(date AS DATE)) % 2 = 0)"""
_FULL = _ROWS + _TITLE + _TITLES + _DOCS + _URLS + _TEXT


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _human(ms: str) -> str:
    s = f"(greatest({ms}, 0) // 1000)"
    h, m = f"({s} // 3600)", f"({s} % 3600 // 60)"
    return f"CASE WHEN {h} > 0 AND {m} > 0 THEN {h} || 'h ' || {m} || 'm' WHEN {h} > 0 THEN {h} || 'h' WHEN {m} > 0 THEN {m} || 'm' ELSE {s} || 's' END"


def _rounded(ms: str) -> str:
    s = f"((greatest({ms}, 0) + 500) // 1000)"
    m = f"(({s} + 30) // 60)"
    return f"CASE WHEN {s} < 60 THEN {s} || 's' WHEN {m} < 60 THEN {m} || 'm' WHEN {m} % 60 = 0 THEN ({m} // 60) || 'h' ELSE ({m} // 60) || 'h ' || ({m} % 60) || 'm' END"


def _clock(ms: str) -> str:
    return f"strftime(make_timestamp({ms} * 1000), '%H:%M')"


def _stamp(ms: str) -> str:
    return f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"


_LONG = "strftime(CAST(date AS DATE), '%A ') || day(CAST(date AS DATE)) || strftime(CAST(date AS DATE), ' %B %Y')"
_DESCRIBE = "CASE WHEN is_private THEN app || ' ({note})' WHEN title IS NOT NULL THEN app || ' — ' || title ELSE app END"
_TOKENS = r"list_transform(list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2), lambda w: lower(w))"


def _tokens(text: str) -> str:
    """Words without consecutive repeats."""
    words = _TOKENS.format(text)
    return f"list_transform(list_filter(list_zip({words}, list_prepend('', {words})), lambda z: z[1] <> z[2] AND z[1] IS NOT NULL), lambda z: z[1])"


_STRIP = r"regexp_replace(regexp_extract(trim({0}), '^[^?#]*'), '/+$', '')"
_HOSTPATH = r"regexp_extract(regexp_replace({0}, '^.*?://', ''), '^[^?#]*')"
_PUBLIC = (
    _FULL
    + r""",
pub AS (SELECT e.stream, e.date, e.id, e.app, CASE WHEN NOT is_private THEN ht.title END AS title, e.start_ms, e.end_ms, e.duration_ms, e.active_ms, e.is_private, e.ep,
  CASE WHEN is_private THEN [] ELSE list_slice(list_filter(coalesce(tl.vs, []), lambda t: t IS DISTINCT FROM ht.title), 1, 5) END AS titles, coalesce(pu.vs, []) AS urls,
  CASE WHEN is_private THEN [] ELSE list_slice(coalesce(dl.vs, []), 1, 5) END AS documents, CASE WHEN is_private THEN [] ELSE list_slice(coalesce(vl.vs, []), 1, 14) END AS visible_text
  FROM e LEFT JOIN ht ON ht.stream = e.stream AND ht.date = e.day AND ht.ep = e.ep LEFT JOIN tl ON tl.stream = e.stream AND tl.date = e.day AND tl.ep = e.ep LEFT JOIN dl ON dl.stream = e.stream AND dl.date = e.day AND dl.ep = e.ep
  LEFT JOIN vl ON vl.stream = e.stream AND vl.date = e.day AND vl.ep = e.ep LEFT JOIN (SELECT stream, date, ep, list(v ORDER BY first) AS vs FROM (
    SELECT *, row_number() OVER (PARTITION BY stream, date, ep ORDER BY first) AS n FROM (SELECT stream, date, ep, """
    + _STRIP.format("url")
    + r""" AS v, min(seq) AS first FROM r WHERE NOT private AND url IS NOT NULL GROUP BY ALL) WHERE v <> '') WHERE n <= 8 GROUP BY ALL) pu ON pu.stream = e.stream AND pu.date = e.day AND pu.ep = e.ep)"""
)
_POSTINGS = (
    _FULL
    + r""",
src AS (
  SELECT stream, date, ep, app AS text, FALSE AS is_url FROM g UNION ALL SELECT stream, date, ep, unnest(vs), FALSE FROM tl UNION ALL SELECT stream, date, ep, unnest(vs), FALSE FROM dl
  UNION ALL SELECT stream, date, ep, unnest(vs), FALSE FROM vl UNION ALL SELECT stream, date, ep, unnest(vs), TRUE FROM ul
), post AS (SELECT DISTINCT unnest("""
    + _TOKENS.format("CASE WHEN is_url THEN " + _HOSTPATH.format("text") + " ELSE text END")
    + r""") AS term, e.stream, e.date, e.id FROM src JOIN e ON e.stream = src.stream AND e.day = src.date AND e.ep = src.ep),
ix AS (SELECT e.*, ht.title FROM e LEFT JOIN ht ON ht.stream = e.stream AND ht.date = e.day AND ht.ep = e.ep QUALIFY row_number() OVER (PARTITION BY e.stream, e.date, e.id ORDER BY end_ms DESC, app DESC) = 1)"""
)


def _search(terms: list[str], n: int) -> str:
    both = " AND ".join(f"bool_or(starts_with(term, '{t}'))" for t in dict.fromkeys(terms))
    return f", hit AS (SELECT stream, date, id FROM post GROUP BY ALL HAVING {both}), top AS (SELECT ix.*, CAST({len(terms)} AS BIGINT) AS matched_terms FROM ix JOIN hit USING (stream, date, id) ORDER BY start_ms DESC, id, stream LIMIT {n})"


def _details() -> str:
    part = lambda label, c, by: f"CASE WHEN len({c}) > 0 THEN '    {label}: ' || array_to_string({c}, '{by}') || chr(10) ELSE '' END"
    return " || ".join([part("visited", "urls", ", "), part("document", "documents", ", "), part("on screen", "visible_text", " · ")])


def _line(when: str) -> str:
    return f"'- ' || {when} || ' ' || app || CASE WHEN is_private THEN ' — private session, nothing recorded' || chr(10) ELSE coalesce(': ' || title, '') || chr(10) || {_details()} END"


_BRIEF = "CASE WHEN {0} > 0 THEN chr(10) || '(' || {0} || ' briefer switches, each under a minute, are counted in the total above but are not listed: they were not worked in.)' || chr(10) ELSE '' END"
_HOURLINES = f""",
hl AS (SELECT stream, date, string_agg(printf('%02d:00', hour) || ' (' || {_human("active_ms")} || ') — ' || trim(text, ' ' || chr(10)) || chr(10), '' ORDER BY hour) AS hour_lines FROM su GROUP BY ALL)"""


def _leaders(name: str, n: int) -> str:
    return f""",
{name} AS (SELECT stream, date, string_agg(app || ' (' || {_human("active_ms")} || ')', ', ' ORDER BY rank) AS leaders FROM us WHERE rank <= {n} GROUP BY ALL)"""


_PAIRS = r"""
msg AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answered FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pr AS (SELECT conv_id AS conv, turn, text AS asked, answered FROM msg WHERE role = 'user' AND next_role = 'assistant')"""
_LINES = r"""
ln AS (SELECT doc_id, CAST(n - 1 AS INTEGER) AS seq, parts[n] AS line FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))"""
_SECRETS = " OR ".join(f"starts_with(lower(c), '{p}')" for p in ("sk-", "sk_", "pk_", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "xox", "aiza", "bearer ", "basic ", "-----begin"))
_SHOWN = (
    r""",
cl AS (SELECT doc_id, seq, line, trim(regexp_replace(line, '\s+', ' ', 'g')) AS c FROM ln),
sh AS (SELECT doc_id, seq, line, c, CASE WHEN length(c) < 2 OR """
    + _SECRETS
    + r""" OR len(list_filter(string_split(c, ' '), lambda w: length(w) >= 20 AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') AND regexp_full_match(w, '[A-Za-z0-9+/=_-]+'))) > 0
  OR regexp_matches(c, '(?i)^file:') OR starts_with(c, '\\') OR (regexp_matches(c, '^[A-Za-z]:[\\/]') AND strlen(c) > 3) THEN NULL ELSE regexp_replace(c, '[0-9](?:[ .-]*[0-9]){11,}', '…', 'g') END AS masked FROM cl),
rd AS (SELECT doc_id, seq, line, c, CASE WHEN length(masked) > 120 THEN substr(masked, 1, 119) || '…' ELSE masked END AS shown FROM sh)"""
)

_PAGE_TITLE = "regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1)"
ORACLES: dict[str, str] = {
    "flagship_app_minutes": _with(_ROWS, "SELECT *, active_ms // 60000 AS minutes, CAST(row_number() OVER (PARTITION BY date ORDER BY active_ms DESC, app) AS INTEGER) AS rank FROM (SELECT date, app, CAST(sum(active_ms) AS BIGINT) AS active_ms FROM e GROUP BY ALL)"),
    "day_stats": _with(_ACT, "SELECT CAST(date AS VARCHAR) AS date, count(*) AS events, arg_max(ms, seq) AS last_ms FROM act GROUP BY ALL"),
    "recorded_days": "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events",
    "kind_filter_counts": _with(_ACT, "SELECT kind, count(*) AS n, kind <> 'sessionLocked' AS is_window, kind = 'sessionLocked' AS is_away, TRUE AS is_emitted, TRUE AS is_known FROM act GROUP BY ALL"),
    "privacy_flags": _with(_ACT, "SELECT stream, count(*) AS n, count(*) FILTER (coalesce(sensitive, FALSE) OR kind = 'privacyBoundary') AS n_private FROM act GROUP BY ALL"),
    "dedup_consecutive": _with(_ACT, "SELECT stream, seq, app, title FROM act WINDOW w AS (PARTITION BY stream ORDER BY seq) QUALIFY row_number() OVER w = 1 OR lag(app) OVER w IS DISTINCT FROM app OR lag(title) OVER w IS DISTINCT FROM title"),
    "excluded_apps_anti": _with(_ACT, "SELECT stream, app, count(*) AS n FROM act WHERE app NOT LIKE '%1' GROUP BY ALL"),
    "excluded_path_filter": _with(_ACT, "SELECT stream, app AS stem, count(*) AS n FROM act WHERE seq % 5 <> 0 GROUP BY ALL"),
    "masked_observations": _with(
        _ACT,
        """SELECT stream, CASE WHEN privacy = 'private' THEN 'privacyBoundary' ELSE kind END AS kind, privacy, count(*) AS n, count(*) FILTER (privacy = 'recordable' AND NOT sensitive AND title IS NOT NULL) AS titles,
        count(*) FILTER (privacy = 'recordable' AND NOT sensitive AND url IS NOT NULL) AS urls FROM (SELECT *, CASE seq % 7 WHEN 0 THEN 'private' WHEN 1 THEN 'undetermined' ELSE 'recordable' END AS privacy FROM act) GROUP BY ALL""",
    ),
    "private_titles": f"""WITH b AS (SELECT page_id, ['chrome', 'edge', 'firefox', 'brave', 'opera', NULL][1 + page_id % 6] AS browser, lower({_PAGE_TITLE} || [' - Incognito', ' - InPrivate', ' (Private Browsing)', ' - Tor', ''][1 + page_id // 6 % 5]) AS title FROM pages),
      c AS (SELECT *, coalesce(CASE browser WHEN 'chrome' THEN contains(title, 'incognito') WHEN 'edge' THEN contains(title, 'inprivate') WHEN 'firefox' THEN contains(title, 'private browsing')
        WHEN 'brave' THEN contains(title, 'private window') OR contains(title, 'private browsing') OR contains(title, 'tor') WHEN 'opera' THEN contains(title, 'private') END, FALSE) AS private FROM b)
      SELECT page_id, browser, private, CASE WHEN browser IS NULL THEN 'recordable' WHEN private THEN 'private' WHEN page_id % 2 = 1 THEN 'undetermined' ELSE 'recordable' END AS privacy FROM c""",
    "control_surfaces": r"""WITH k AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<(nav|footer|aside|p|h1|li|div|article)[ >]', 1) AS t FROM pages), r AS (SELECT page_id, t, unnest(generate_series(1, len(t))) AS i FROM k)
      SELECT page_id, CAST(CASE WHEN t[i] IN ('nav', 'footer') OR (i > 1 AND t[i - 1] IN ('nav', 'footer')) OR (i > 2 AND t[i - 2] IN ('nav', 'footer')) OR t[i] IN ('aside', 'li', 'article') THEN 2 WHEN t[i] IN ('p', 'h1') THEN 0 ELSE 1 END AS INTEGER) AS surface, count(*) AS n FROM r GROUP BY ALL""",
    "episodes_core": _with(_ROWS, "SELECT stream, date, id, app, start_ms, end_ms, duration_ms, active_ms, event_count, is_private FROM e"),
    "episodes_by_ranges": _with(_ROWS, "SELECT stream, date, id, app, start_ms, end_ms, duration_ms, active_ms, event_count, is_private FROM e"),
    "episode_headline_title": _with(_ROWS + _TITLE, "SELECT e.stream, e.date, e.id, ht.title FROM e LEFT JOIN ht ON ht.stream = e.stream AND ht.date = e.day AND ht.ep = e.ep"),
    **{
        name: _with(_ROWS + cte, f"SELECT e.stream, e.date, e.id, coalesce(t.v, '') AS {column} FROM e LEFT JOIN {alias} t ON t.stream = e.stream AND t.date = e.day AND t.ep = e.ep")
        for name, cte, alias, column in (("episode_titles_ordered", _TITLES, "tl", "titles"), ("episode_documents_capped", _DOCS, "dl", "documents"), ("episode_urls_ordered", _URLS, "ul", "urls"), ("episode_visible_text", _TEXT, "vl", "visible_text"))
    },
    "episode_descriptions": _with(
        _ROWS + _TITLE, f"SELECT stream, date, id, {_stamp('start_ms')} AS start, {_stamp('end_ms')} AS \"end\", {_DESCRIBE.format(note='private')} AS description FROM (SELECT e.*, ht.title FROM e LEFT JOIN ht ON ht.stream = e.stream AND ht.date = e.day AND ht.ep = e.ep)"
    ),
    "session_gap_only": _with(
        _ACT,
        """SELECT stream, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS events FROM (SELECT *, sum(st) OVER (PARTITION BY stream ORDER BY ms, seq) AS sn FROM (
        SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY stream ORDER BY ms, seq) <= 900000 THEN 0 ELSE 1 END AS st FROM act)) GROUP BY stream, sn""",
    ),
    "app_usage_day": _with(_ROWS + _DAYS, "SELECT stream, date, app, active_ms, episodes, rank FROM us"),
    "daily_rollup": _with(_ROWS + _DAYS, "SELECT * FROM dy"),
    "hour_slices": _with(_ROWS + _SLICES, "SELECT stream, date, id, app, hour, pos, share_ms FROM sl"),
    "hourly_rollup": _with(_ROWS + _SLICES, "SELECT * FROM hr"),
    "hourly_app_usage": _with(_ROWS + _SLICES, "SELECT * FROM hap"),
    "hour_episode_ids": _with(_ROWS + _SLICES, "SELECT stream, date, hour, string_agg(id, '|' ORDER BY ep) AS episode_ids FROM (SELECT stream, date, hour, id, min(ep) AS ep FROM sl GROUP BY ALL) GROUP BY ALL"),
    "leading_app_hour": _with(_ROWS + _SLICES, "SELECT stream, date, hour, app, active_ms, episodes FROM hap WHERE rank = 1"),
    "usage_subtotals": _with(_ROWS + _SLICES, "SELECT date, hour, app, CAST(sum(share_ms) AS BIGINT) AS active_ms, CAST(grouping(date, hour, app) AS BIGINT) AS level FROM sl GROUP BY ROLLUP (date, hour, app)"),
    "timeline_groups": _with(
        _ROWS + _SLICES, "SELECT q.stream, q.date, q.hour, coalesce(hr.active_ms, q.own) AS active_ms, q.episodes, q.episode_ids FROM (SELECT stream, date, CAST(start_ms // 3600000 % 24 AS INTEGER) AS hour, CAST(sum(active_ms) AS BIGINT) AS own, count(*) AS episodes, string_agg(id, '|' ORDER BY start_ms DESC, id DESC) AS episode_ids FROM e GROUP BY ALL) q LEFT JOIN hr USING (stream, date, hour)"
    ),
    "timeline_headlines": _with(
        _ROWS + _DAYS,
        f"""SELECT dy.stream, dy.date, {_human("dy.active_ms")} || ' active · ' || dy.episodes || ' episode' || CASE WHEN dy.episodes = 1 THEN '' ELSE 's' END || CASE WHEN n > 1 THEN ' · mostly ' || leader ELSE '' END
        || CASE WHEN private_episodes > 0 THEN ' · ' || private_episodes || ' private session' || CASE WHEN private_episodes = 1 THEN '' ELSE 's' END ELSE '' END AS headline FROM dy JOIN (SELECT stream, date, count(*) AS n, arg_min(app, rank) AS leader FROM us GROUP BY ALL) USING (stream, date)""",
    ),
    "app_share": _with(
        _ROWS + _DAYS, "SELECT * EXCLUDE (screen_ms) FROM (SELECT us.stream, us.date, app, us.active_ms, screen_ms, CAST(CASE WHEN screen_ms > 0 THEN floor(100.0 * us.active_ms / screen_ms + 0.5) ELSE 0 END AS BIGINT) AS share, count(*) FILTER (us.active_ms < 60000) OVER (PARTITION BY us.stream, us.date) AS brief_apps FROM us JOIN dy USING (stream, date)) WHERE active_ms >= 60000"
    ),
    "hour_bar_width": _with(_ROWS + _SLICES, "SELECT stream, date, hour, active_ms, busiest_ms, CAST(CASE WHEN busiest_ms > 0 THEN floor(100.0 * active_ms / busiest_ms + 0.5) ELSE 0 END AS BIGINT) AS width FROM (SELECT *, max(active_ms) OVER (PARTITION BY stream, date) AS busiest_ms FROM hr)"),
    "tokenize_documents": f"WITH t AS (SELECT doc_id, {_tokens('text')} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, md5(array_to_string(w, ' ')) AS digest FROM t",
    "url_terms": f"SELECT page_id, array_to_string({_tokens(_HOSTPATH.format('url'))}, ' ') AS terms FROM pages",
    "strip_query_urls": f"SELECT page_id, {_STRIP.format('url')} AS url FROM pages",
    "normalize_urls": r"""WITH w AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^.*?://', '') WHEN page_id % 7 = 1 THEN url || ' and words' WHEN page_id % 7 = 2 THEN regexp_replace(url, '^.*?://[^/]*', 'localhost') ELSE url END AS raw FROM pages),
      n AS (SELECT page_id, raw, CASE WHEN regexp_matches(raw, '^(https?|file)://') THEN raw WHEN contains(raw, ' ') OR NOT contains(split_part(raw, '/', 1), '.') THEN NULL ELSE 'https://' || raw END AS url FROM w)
      SELECT page_id, url, 'C:\pages\' || page_id AS path, CASE WHEN length(raw) <= 120 THEN url END AS doc FROM n""",
    "document_labels": rf"""WITH t AS (SELECT page_id, url, trim({_PAGE_TITLE}) AS title FROM pages)
      SELECT page_id, CASE WHEN page_id % 4 = 0 AND title <> '' THEN title ELSE regexp_extract(regexp_replace(regexp_replace(split_part(url, '://', 2), '[?#].*$', ''), '/+$', ''), '[^/]*$') END AS label,
        page_id % 4 = 0 AND length(title) >= 3 AND (page_id % 8 = 0 OR contains(lower(url), lower(title))) AS names_window FROM t""",
    "postings": _with(_POSTINGS, "SELECT term, count(*) AS episodes, count(DISTINCT date) AS days, min(id) AS first_id FROM post GROUP BY ALL"),
    "index_cardinality": _with(_POSTINGS, "SELECT (SELECT count(*) FROM ix) AS episodes, (SELECT count(DISTINCT term) FROM post) AS terms"),
    "search_and_prefix": _with(_POSTINGS + _search(["app", "title"], 200), f"SELECT stream, date, id, app, title, {_stamp('start_ms')} AS start, matched_terms FROM top"),
    "search_results_redacted": _with(_POSTINGS + _search(["app"], 200), "SELECT stream, id, app, CASE WHEN NOT is_private THEN title END AS title, is_private, matched_terms FROM top"),
    "forget_day": _with(_POSTINGS, "SELECT date, count(*) AS n, count(DISTINCT term) AS terms FROM post WHERE date <> '2024-01-05' GROUP BY ALL"),
    "public_episodes": _with(
        _PUBLIC, f"SELECT stream, date, id, app, title, array_to_string(titles, '|') AS titles, array_to_string(urls, '|') AS urls, array_to_string(documents, '|') AS documents, array_to_string(visible_text, '|') AS visible_text, duration_ms, active_ms, is_private, {_DESCRIBE.format(note='private session, nothing recorded')} AS description FROM pub"
    ),
    "recent_episodes": _with(_ROWS, "SELECT stream, date, id, app, active_ms FROM e WHERE date BETWEEN '2024-01-14' AND '2024-01-20' ORDER BY date DESC, start_ms DESC, id DESC, stream LIMIT 50"),
    "redact_lines_scalar": _with(_LINES + _SHOWN, "SELECT doc_id, seq, shown FROM rd"),
    "human_durations": _with(_ROWS, f"SELECT stream, date, id, duration_ms, {_human('duration_ms')} AS truncated, {_rounded('duration_ms')} AS rounded, {_clock('start_ms')} AS clock FROM e"),
    "file_sizes": "SELECT doc_id, CASE WHEN n < 1000 THEN n || ' bytes' ELSE printf('%.1f kB', floor(n / 100 + 0.5) / 10) END AS size FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)",
    "stale_hours": _with(_ROWS + _SLICES + _DAYS + _SUMS, "SELECT stream, date, hour, hr.active_ms, su.active_ms AS written_ms, hr.active_ms >= 60000 AND hr.active_ms - su.active_ms >= 60000 AS stale FROM hr JOIN su USING (stream, date, hour)"),
    "run_plan": _with(
        _ROWS + _SLICES + _DAYS + _SUMS, "SELECT stream, date, hour, hr.active_ms, su.active_ms AS written_ms, CASE WHEN hr.active_ms - su.active_ms < 60000 THEN 'skip' WHEN hr.active_ms < 60000 THEN 'quiet' ELSE 'write' END AS action FROM hr LEFT JOIN su USING (stream, date, hour)"
    ),
    "run_report": _with(
        _ROWS + _SLICES + _DAYS + _SUMS,
        """, p AS (SELECT stream, date, hour, CASE WHEN hr.active_ms - su.active_ms < 60000 THEN 'skip' WHEN hr.active_ms < 60000 THEN 'quiet' ELSE 'write' END AS action FROM hr LEFT JOIN su USING (stream, date, hour))
        SELECT stream, date, coalesce(string_agg(CAST(hour AS VARCHAR), ',' ORDER BY hour) FILTER (action = 'write'), '') AS hours_write, coalesce(string_agg(CAST(hour AS VARCHAR), ',' ORDER BY hour) FILTER (action = 'skip'), '') AS hours_skip,
        coalesce(string_agg(CAST(hour AS VARCHAR), ',' ORDER BY hour) FILTER (action = 'quiet'), '') AS hours_quiet FROM p GROUP BY ALL""",
    ),
    "hour_prompt": _with(
        _PUBLIC + _SLICES,
        f""", j AS (SELECT DISTINCT ON (sl.stream, sl.date, sl.hour, sl.id) sl.hour, sl.pos, pub.* FROM sl JOIN pub USING (stream, date, id) ORDER BY sl.stream, sl.date, sl.hour, sl.id, sl.pos),
        k AS (SELECT *, active_ms >= 60000 OR NOT bool_or(active_ms >= 60000) OVER (PARTITION BY stream, date, hour) AS named FROM j),
        o AS (SELECT *, sum(CAST(named AS INTEGER)) OVER (PARTITION BY stream, date, hour ORDER BY start_ms, pos, id ROWS UNBOUNDED PRECEDING) AS nth FROM k),
        t AS (SELECT stream, date, hour, coalesce(string_agg({
            _line(
                f"({_clock('start_ms')} || CASE WHEN start_ms // 3600000 % 24 <> hour THEN ', began before this hour (' || {_human('active_ms')} || ' in all)' WHEN end_ms // 3600000 % 24 <> hour THEN ', runs past this hour (' || {_human('active_ms')} || ' in all)' ELSE ' (' || {_human('active_ms')} || ')' END)"
            )
        }, '' ORDER BY start_ms, pos, id) FILTER (named AND nth <= 25), '') AS lines, count(*) FILTER (named) AS n_named, count(*) FILTER (NOT named) AS n_brief FROM o GROUP BY ALL)
        SELECT stream, date, hour, 'Activity for ' || {_LONG} || printf(' between %02d:00 and %02d:59, ', hour, hour) || {_human("hr.active_ms")} || ' of it active.' || chr(10) || chr(10) || lines
        || CASE WHEN n_named > 25 THEN chr(10) || '(' || (n_named - 25) || ' further short entries omitted.)' || chr(10) ELSE '' END || {_BRIEF.format("n_brief")} || chr(10) || '{_ASK_HOUR}' AS user, {_HOUR_TOKENS} AS max_tokens
        FROM t JOIN hr USING (stream, date, hour) WHERE hr.active_ms >= 60000""",
    ),
    "day_prompt": _with(
        _ROWS + _SLICES + _DAYS + _SUMS + _HOURLINES + _leaders("ld", 5),
        f"""SELECT stream, date, 'Hour-by-hour summaries for ' || {_LONG} || ', ' || {_human("active_ms")} || ' active in total across ' || episodes || ' sessions.' || chr(10) || chr(10) || hour_lines || coalesce(chr(10) || 'Time by application: ' || leaders || '.' || chr(10), '')
        || CASE WHEN private_episodes > 0 THEN private_episodes || ' private sessions were recorded as time only.' || chr(10) ELSE '' END || chr(10) || '{_ASK_DAY}' AS user, {_DAY_TOKENS} AS max_tokens FROM dy JOIN hl USING (stream, date) LEFT JOIN ld USING (stream, date)""",
    ),
    "chat_prompt": _with(
        _PUBLIC + _SLICES + _DAYS + _SUMS + _HOURLINES + _leaders("ld", 8) + "," + _PAIRS,
        f""", n AS (SELECT *, row_number() OVER (PARTITION BY stream, date ORDER BY start_ms, id, app) AS nth FROM pub WHERE active_ms >= 60000),
        li AS (SELECT stream, date, string_agg({_line(f"({_clock('start_ms')} || ' (' || {_human('active_ms')} || ')')")}, '' ORDER BY nth) FILTER (nth <= 120) AS lines, count(*) AS n_named FROM n GROUP BY ALL),
        tu AS (SELECT dy.stream, dy.date, conv, turn, trim(asked, ' ' || chr(10)) AS asked, trim(answered, ' ' || chr(10)) AS answered, row_number() OVER (PARTITION BY dy.stream, dy.date ORDER BY conv DESC, turn DESC) AS back FROM dy JOIN pr ON pr.conv % 4 = dy.stream AND pr.conv // 4 % 30 = day(CAST(dy.date AS DATE)) - 1),
        sd AS (SELECT stream, date, string_agg('They asked: ' || asked || chr(10) || 'You answered: ' || answered || chr(10), '' ORDER BY conv, turn) AS said FROM tu WHERE back <= 8 GROUP BY ALL)
        SELECT stream, date, 'Activity for ' || {_LONG} || ', ' || {_human("active_ms")} || ' active in total across ' || episodes || ' sessions.' || chr(10) || chr(10) || coalesce('The summary already written for this day:' || chr(10) || trim(daily) || chr(10) || chr(10), '')
        || coalesce('Hour by hour:' || chr(10) || hour_lines || chr(10), '') || CASE WHEN n_named IS NULL THEN 'Nothing was in front for longer than a minute on this day.' || chr(10) || chr(10) ELSE 'What was in front, in the order it happened:' || chr(10) || lines
        || CASE WHEN n_named > 120 THEN chr(10) || '(' || (n_named - 120) || ' further entries are not listed.)' || chr(10) ELSE '' END || {_BRIEF.format("(episodes - n_named)")} || chr(10) END || coalesce('Time by application: ' || leaders || '.' || chr(10) || chr(10), '')
        || CASE WHEN private_episodes > 0 THEN private_episodes || ' private sessions were recorded as time only.' || chr(10) || chr(10) ELSE '' END || coalesce('Earlier in this conversation:' || chr(10) || said || chr(10), '') || 'Their question: {_QUESTION}' || chr(10) || chr(10) || '{_ASK_CHAT}' AS user, {_CHAT_TOKENS} AS max_tokens
        FROM dy LEFT JOIN li USING (stream, date) LEFT JOIN hl USING (stream, date) LEFT JOIN ld USING (stream, date) LEFT JOIN da USING (stream, date) LEFT JOIN sd USING (stream, date)""",
    ),
    "chat_tail": _with(_PAIRS, "SELECT conv, turn, asked, answered FROM pr QUALIFY row_number() OVER (PARTITION BY conv ORDER BY turn DESC) <= 8"),
    "day_document": _with(
        _ROWS + _SLICES + _DAYS + _SUMS,
        f""", ap AS (SELECT stream, date, string_agg('- ' || app || ' — ' || {_human("active_ms")} || chr(10), '' ORDER BY rank) AS apps FROM us GROUP BY ALL),
        ho AS (SELECT stream, date, string_agg(printf('### %02d:00', hour) || ' — ' || {_human("active_ms")} || chr(10) || chr(10) || trim(text, ' ' || chr(10)) || chr(10) || chr(10), '' ORDER BY hour) AS hours, arg_min(model, hour) AS model FROM su GROUP BY ALL)
        SELECT stream, date, {_LONG} AS title, '# ' || {_LONG} || chr(10) || chr(10) || coalesce(trim(daily) || chr(10) || chr(10), 'No whole-day summary was written.' || chr(10) || chr(10)) || '## Where the time went' || chr(10) || chr(10)
        || CASE WHEN screen_ms = 0 THEN 'Nothing was recorded on this day.' || chr(10) || chr(10) ELSE {_human("screen_ms")} || ' at the machine, ' || {_human("active_ms")} || ' of it working.' || chr(10) || chr(10) || coalesce(apps, '') || CASE WHEN idle_ms > 0 THEN '- Idle — ' || {_human("idle_ms")} || chr(10) ELSE '' END || chr(10) END
        || coalesce('## Hours' || chr(10) || chr(10) || hours, '') || coalesce('---' || chr(10) || chr(10) || 'Summaries written by ' || coalesce(model, CASE WHEN daily IS NOT NULL THEN 'an unnamed model' END) || '.' || chr(10), '') AS body
        FROM dy LEFT JOIN ap USING (stream, date) LEFT JOIN ho USING (stream, date) LEFT JOIN da USING (stream, date)""",
    ),
    "summary_upsert": _with(
        _ROWS + _SLICES + _DAYS + _SUMS, "SELECT stream, date, hour, active_ms, text FROM su WHERE NOT EXISTS (SELECT 1 FROM hr WHERE hr.stream = su.stream AND hr.date = su.date AND hr.hour = su.hour AND hr.hour % 5 = 1) UNION ALL SELECT stream, date, hour, active_ms, 'rewritten' FROM hr WHERE hour % 5 = 1"
    ),
    "stream_day_counts": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS events FROM events GROUP BY ALL",
    "stream_hour_counts": "SELECT epoch_ms(date_trunc('hour', ts)) AS start_ms, count(*) AS events FROM events GROUP BY ALL",
    "stream_episodes": _with(_ROWS, "SELECT date, stream, count(*) AS episodes, CAST(sum(active_ms) AS BIGINT) AS active_ms FROM e GROUP BY ALL"),
    "stream_dedup": _with(_ACT, "SELECT stream, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM (SELECT stream, seq FROM act WINDOW w AS (PARTITION BY stream ORDER BY seq) QUALIFY row_number() OVER w = 1 OR lag(app) OVER w IS DISTINCT FROM app OR lag(title) OVER w IS DISTINCT FROM title) GROUP BY ALL"),
    "paragraphs": r"""WITH w AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(concat_ws(chr(10) || chr(10), role, regexp_replace(text, '\. ', '.' || chr(10) || ' ' || chr(10), 'g')), '\n\s*\n'), lambda p: trim(p, ' ' || chr(10) || chr(9))), lambda p: p <> '') AS ps FROM conversations)
      SELECT conv_id, turn, CAST(n - 1 AS INTEGER) AS pos, ps[n] AS paragraph FROM (SELECT *, unnest(generate_series(1, len(ps))) AS n FROM w)""",
}

_SHIFTED = _ROWS.replace("epoch_us(e.ts) // 1000 AS ms", "epoch_us(e.ts) // 1000 - CASE WHEN e.event_id % 50 = 0 AND day(CAST(e.ts AS DATE)) % 2 = 0 THEN 1200000 ELSE 0 END AS ms")
_OPENERS = ("here is a summary:", "here''s a summary:", "here is the summary:", "here''s the summary:", "summary:")


def _without_openers(text: str) -> str:
    for o in _OPENERS:
        n = len(o.replace("''", "'"))
        text = f"(SELECT CASE WHEN lower(substr(t, 1, {n})) = '{o}' THEN ltrim(substr(t, {n + 1}), ' ' || chr(9) || chr(10) || chr(13)) ELSE t END FROM (SELECT {text} AS t))"
    return text


_WS = "' ' || chr(9) || chr(10) || chr(13)"
_MARKDOWN = r"""
ml AS (SELECT doc_id, 2 * seq + 1 AS seq, CASE WHEN seq % 7 = 0 THEN '## ' || line WHEN seq % 7 IN (1, 2) THEN '- ' || line ELSE line END AS raw FROM ln
  UNION ALL SELECT doc_id, 2 * seq, CASE WHEN seq % 7 = 3 THEN '---' ELSE '' END FROM ln WHERE seq % 7 IN (3, 4)),
mt AS (SELECT doc_id, seq, trim(raw, ' ' || chr(9) || chr(13)) AS t FROM ml),
mk AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^-{3,}$') THEN 'rule' WHEN regexp_matches(t, '^(#{1,6})\s+(.*)$') THEN 'heading' WHEN regexp_matches(t, '^[-*]\s+(.*)$') THEN 'list' ELSE 'paragraph' END AS kind FROM mt),
mx AS (SELECT *, CASE kind WHEN 'heading' THEN trim(regexp_extract(t, '^(#{1,6})\s+(.*)$', 2)) WHEN 'list' THEN trim(regexp_extract(t, '^[-*]\s+(.*)$', 1)) WHEN 'paragraph' THEN t ELSE '' END AS body, CASE kind WHEN 'heading' THEN least(length(regexp_extract(t, '^(#{1,6})', 1)), 3) ELSE 0 END AS level,
  CASE WHEN kind IN ('heading', 'rule', 'blank') OR lag(kind) OVER (PARTITION BY doc_id ORDER BY seq) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS new FROM mk),
mb AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY seq) AS block FROM mx),
bl AS (SELECT doc_id, block, kind, level, sum(length(body)) + count(*) - 1 AS chars FROM mb WHERE kind <> 'blank' GROUP BY ALL)"""

_FOLD = """,
n AS (SELECT stream, date, seq, ms, away, private, app, row_number() OVER (PARTITION BY stream, date ORDER BY seq) AS k, count(*) OVER (PARTITION BY stream, date) AS size FROM rel),
f AS (
  SELECT stream, date, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS app, FALSE AS private, CAST(NULL AS BIGINT) AS start, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS active, CAST(0 AS BIGINT) AS cnt,
    CAST(NULL AS VARCHAR) AS c_app, FALSE AS c_private, CAST(NULL AS BIGINT) AS c_start, CAST(0 AS BIGINT) AS c_end, CAST(0 AS BIGINT) AS c_active, CAST(0 AS BIGINT) AS c_n FROM (SELECT DISTINCT stream, date FROM n)
  UNION ALL
  SELECT stream, date, k, CASE WHEN away THEN NULL ELSE r_app END, r_private, CASE WHEN away THEN NULL WHEN stays THEN start ELSE ms END, CASE WHEN stays THEN greatest(last, ms) ELSE ms END,
    CASE WHEN stays THEN active + least(greatest(ms - last, 0), 300000) ELSE 0 END, CASE WHEN stays THEN cnt + 1 ELSE 1 END,
    app, private, CASE WHEN stays THEN NULL ELSE start END, fin, active + least(greatest(fin - last, 0), 300000), cnt
  FROM (SELECT *, greatest(CASE WHEN idle THEN last ELSE ms END, start) AS fin FROM (
    SELECT f.*, n.k AS k_, n.ms, n.away, n.private AS r_private, n.app AS r_app, NOT n.away AND n.ms - f.last > 900000 AS idle, f.start IS NOT NULL AND NOT n.away AND n.ms - f.last <= 900000 AND f.app = n.app AND f.private = n.private AS stays
    FROM f JOIN n ON n.stream = f.stream AND n.date = f.date AND n.k = f.k + 1) AS q(stream, date, k0, app, private, start, last, active, cnt, c_app, c_private, c_start, c_end, c_active, c_n, k, ms, away, r_private, r_app, idle, stays))
)"""


def _throttle(every: int) -> str:
    """One row of each stream after the other: the last read of more than one line, and when it was."""
    return f"""WITH RECURSIVE {_ACT}, n AS (SELECT stream, ms, app, CASE WHEN seq % 3 = 0 THEN 1 ELSE 2 END AS lines, row_number() OVER (PARTITION BY stream ORDER BY seq) AS k FROM act),
    f AS (SELECT stream, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS app, CAST(NULL AS VARCHAR) AS last, CAST(0 AS BIGINT) AS since, FALSE AS due FROM (SELECT DISTINCT stream FROM n)
      UNION ALL SELECT stream, k, app, CASE WHEN d AND lines > 1 THEN app ELSE last END, CASE WHEN d AND lines > 1 THEN ms ELSE since END, d
      FROM (SELECT n.*, f.last, f.since, f.last IS NULL OR f.last <> n.app OR n.ms - f.since >= {every} AS d FROM f JOIN n ON n.stream = f.stream AND n.k = f.k + 1))
    SELECT stream, app, count(*) AS n FROM f WHERE due GROUP BY ALL"""


ORACLES |= {
    "redact_budget": _with(
        _LINES + _SHOWN,
        """, ti AS (SELECT doc_id, arg_min(c, seq) AS title FROM rd GROUP BY ALL), di AS (SELECT doc_id, shown, min(seq % 3 * 1000000 + seq) AS place FROM rd JOIN ti USING (doc_id) WHERE shown IS NOT NULL AND shown IS DISTINCT FROM title GROUP BY ALL),
        li AS (SELECT doc_id, list({'kept': [shown], 'total': CAST(length(shown) AS BIGINT)} ORDER BY place) AS x FROM di GROUP BY ALL)
        SELECT doc_id, coalesce(array_to_string(list_reduce(x, lambda a, b: CASE WHEN len(a.kept) < 12 AND a.total + b.total <= 1000 THEN {'kept': list_concat(a.kept, b.kept), 'total': a.total + b.total} ELSE a END, {'kept': CAST([] AS VARCHAR[]), 'total': CAST(0 AS BIGINT)}).kept, chr(10)), '') AS shown
        FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN li USING (doc_id)""",
    ),
    "episodes_any_order": "WITH RECURSIVE " + _SHIFTED + _FOLD + """,
done AS (
  SELECT stream, date, c_app AS app, c_private AS is_private, c_start AS start_ms, c_end AS end_ms, c_active AS active_ms, c_n AS event_count FROM f WHERE c_start IS NOT NULL
  UNION ALL
  SELECT f.stream, f.date, f.app, f.private, f.start, greatest(f.last, f.start), f.active, f.cnt FROM f JOIN (SELECT DISTINCT stream, date, size FROM n) z ON z.stream = f.stream AND z.date = f.date AND z.size = f.k WHERE f.start IS NOT NULL
)
SELECT stream, CAST(date AS VARCHAR) AS date, CAST(date AS VARCHAR) || '#' || start_ms AS id, app, start_ms, end_ms, end_ms - start_ms AS duration_ms, active_ms, event_count, is_private FROM done""",
    "episodes_any_order_full": "WITH RECURSIVE " + _SHIFTED.replace("\nr AS (", "\nr_in_order AS (").replace(" FROM r GROUP BY ALL", " FROM r_in_order GROUP BY ALL") + _FOLD + """,
r AS (SELECT rel.*, x.ep, x.credit FROM rel JOIN (
  SELECT n.stream, n.date, n.seq, sum(CASE WHEN f.start IS NOT NULL AND f.cnt = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY n.stream, n.date ORDER BY n.k) AS ep, coalesce(coalesce(CASE WHEN g.c_start IS NOT NULL THEN g.c_active END, g.active) - f.active, 0) AS credit
  FROM n JOIN f ON f.stream = n.stream AND f.date = n.date AND f.k = n.k LEFT JOIN f g ON g.stream = f.stream AND g.date = f.date AND g.k = f.k + 1) x ON x.stream = rel.stream AND x.date = rel.date AND x.seq = rel.seq WHERE NOT rel.away)""" + _TITLE + _TITLES + _DOCS + _URLS + _TEXT + """,
ep AS (SELECT stream, date, ep, arg_min(app, seq) AS app, arg_min(ms, seq) AS start_ms, CAST(sum(credit) AS BIGINT) AS active_ms, count(*) AS event_count FROM r GROUP BY ALL)
SELECT ep.stream, CAST(ep.date AS VARCHAR) AS date, CAST(ep.date AS VARCHAR) || '#' || start_ms AS id, app, ht.title, coalesce(tl.v, '') AS titles, coalesce(ul.v, '') AS urls, coalesce(dl.v, '') AS documents, coalesce(vl.v, '') AS visible_text, active_ms, event_count
FROM ep LEFT JOIN ht USING (stream, date, ep) LEFT JOIN tl USING (stream, date, ep) LEFT JOIN ul USING (stream, date, ep) LEFT JOIN dl USING (stream, date, ep) LEFT JOIN vl USING (stream, date, ep)""",
    "read_throttle": _throttle(30_000),
    "read_throttle_long": _throttle(600_000),
    "day_view": _with(
        _ROWS + _SLICES + _DAYS + _SUMS,
        """, hs AS (SELECT stream, date, string_agg(hour || ':' || active_ms || ':' || text, '|' ORDER BY hour) AS hours FROM su GROUP BY ALL)
        SELECT dy.stream, dy.date, active_ms, idle_ms, screen_ms, episodes, private_episodes, trim(daily) AS daily_summary, coalesce(hours, '') AS hours FROM dy LEFT JOIN da USING (stream, date) LEFT JOIN hs USING (stream, date)""",
    ),
    "tidy_text": f"""WITH r AS (SELECT conv_id, turn, ['Summary: ', '  ', 'here IS the summary:' || chr(10)][1 + turn % 3] || CASE WHEN conv_id % 2 = 0 THEN '"' || text || '"' ELSE text || chr(10) || ' ' || chr(10) || 'end' || chr(10) || 'of it' END AS raw FROM conversations WHERE text IS NOT NULL),
      o AS (SELECT conv_id, turn, {_without_openers(f"trim(raw, {_WS})")} AS t FROM r),
      q AS (SELECT conv_id, turn, CASE WHEN length(t) > 1 AND starts_with(t, '"') AND ends_with(t, '"') AND NOT contains(substr(t, 2, length(t) - 2), '"') THEN trim(substr(t, 2, length(t) - 2), {_WS}) ELSE t END AS t FROM o)
      SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '\\r?\\n(?:[ \\t\\r]*\\n)+'), lambda p: array_to_string(list_filter(list_transform(regexp_split_to_array(p, '\\r?\\n'), lambda x: trim(x, {_WS})), lambda x: x <> ''), ' ')), lambda p: p <> ''), chr(10) || chr(10)) AS tidied FROM q""",
    "markdown_blocks": _with(_LINES + "," + _MARKDOWN, "SELECT doc_id, kind, count(*) AS blocks, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(level) AS BIGINT) AS levels FROM bl GROUP BY ALL"),
}

_ONE_STREAM = _ROWS.replace("CAST(e.user_id % 4 AS INTEGER) AS stream", "0 AS stream")
ORACLES |= {
    "log_round_trip": _with(
        _ACT,
        "SELECT CAST(date AS VARCHAR) AS date, count(*) AS events, strftime(make_timestamp(arg_max(ms, seq) * 1000), '%Y-%m-%dT%H:%M:%S.') || printf('%03dZ', arg_max(ms, seq) % 1000) AS last_event_at, CAST(0 AS BIGINT) AS out_of_order, count(title) AS titles, count(url) AS urls FROM act GROUP BY ALL",
    ),
    "store_episodes": "WITH "
    + _ONE_STREAM
    + _TITLE
    + _URLS
    + f""",
tw AS (SELECT e.date, e.id, unnest({_tokens("r.app")}) AS term FROM e JOIN r ON r.date = e.day AND r.ep = e.ep
  UNION SELECT e.date, e.id, unnest(list_concat(list_concat({_tokens("coalesce(r.title, '')")}, {_tokens(_HOSTPATH.format("coalesce(r.url, '')"))}), list_concat({_tokens("coalesce(r.document, '')")}, list_concat({_tokens("'line ' || (r.k % 11)")}, ['status', 'bar'])))) FROM e JOIN r ON r.date = e.day AND r.ep = e.ep WHERE NOT e.is_private),
tn AS (SELECT date, id, count(DISTINCT term) AS terms FROM tw GROUP BY ALL)
SELECT e.date, e.id, app, ht.title, coalesce(ul.v, '') AS urls, duration_ms, active_ms, event_count, is_private, coalesce(terms, 0) AS terms
FROM e LEFT JOIN ht ON ht.date = e.day AND ht.ep = e.ep LEFT JOIN ul ON ul.date = e.day AND ul.ep = e.ep LEFT JOIN tn ON tn.date = e.date AND tn.id = e.id""",
    "parsed_instants": "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) ELSE 'none' END AS ms FROM events",
    "capture_filters": _with(_ACT, "SELECT stream, app, count(*) AS n, count(*) FILTER (app = 'app_0' OR title = 'title 3') AS n_deep, count(*) FILTER (title NOT IN ('title 1', 'title 2')) AS n_shown FROM act WHERE app <> 'app_1' GROUP BY ALL"),
    "retained_days": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15' GROUP BY ALL",
    "message_helpers": r"""WITH m AS (SELECT *, coalesce(text, '') AS t FROM conversations)
      SELECT conv_id, turn, CASE WHEN trim(regexp_replace(t, '\s+', ' ', 'g')) = '' THEN 'Untitled' ELSE trim(regexp_replace(t, '\s+', ' ', 'g')) END AS title,
        array_to_string(list_slice(list_filter(string_split(substr(replace(t, '. ', '.' || chr(10)), 1, 4000), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''), 1, 3), '|') AS writing,
        sha256(t) AS digest, CASE WHEN turn % 3 = 0 THEN role END AS bearer, CASE WHEN conv_id % 2 = 0 THEN TRUE ELSE regexp_full_match(substr(t, 1, 9), '[A-Za-z0-9_-]+') END AS valid FROM m""",
    "accepted_tokens": "SELECT doc_id FROM documents WHERE coalesce(text, '') IN (SELECT coalesce(text, '') FROM documents WHERE doc_id % 3 = 0)",
}

ORACLES |= {
    "episodes_by_ranges_any_order": ORACLES["episodes_any_order"],
    # an episode's number is that of the row that closes it; what is open at the end comes last
    "hour_episode_ids_any_order": "WITH RECURSIVE " + _SHIFTED + _FOLD + """,
closed AS (
  SELECT stream, date, k, c_start AS start_ms, c_end AS end_ms, c_active AS active_ms, c_app AS app FROM f WHERE c_start IS NOT NULL
  UNION ALL
  SELECT f.stream, f.date, f.k + 1, f.start, greatest(f.last, f.start), f.active, f.app FROM f JOIN (SELECT DISTINCT stream, date, size FROM n) z ON z.stream = f.stream AND z.date = f.date AND z.size = f.k WHERE f.start IS NOT NULL
),
numbered AS (SELECT stream, CAST(date AS VARCHAR) AS date, CAST(date AS VARCHAR) || '#' || start_ms AS id, app, start_ms, end_ms, active_ms, row_number() OVER (PARTITION BY stream, date ORDER BY k) AS ep FROM closed)""" + _SLICES.replace("AS h FROM e)", "AS h FROM numbered)") + """
SELECT stream, date, hour, string_agg(id, '|' ORDER BY ep) AS episode_ids FROM (SELECT stream, date, hour, id, min(ep) AS ep FROM sl GROUP BY ALL) GROUP BY ALL""",
    "stream_open_sessions": ORACLES["episodes_core"],
    # a day's rows are those of the second log; days of which only locks are left have no episodes
    "processed_days": _with(
        _ONE_STREAM.replace("rel AS (SELECT *,", "kept AS (SELECT * FROM act WHERE kind = 'sessionLocked' OR (day(date) % 3 <> 0 AND day(date) % 4 <> 0)),\nrel AS (SELECT *,").replace("AS private FROM act WHERE", "AS private FROM kept WHERE"),
        "SELECT CAST(d.date AS VARCHAR) AS date, count(e.id) AS episodes, CAST(coalesce(sum(active_ms), 0) AS BIGINT) AS active_ms FROM (SELECT DISTINCT date FROM kept) d LEFT JOIN e ON e.day = d.date GROUP BY ALL",
    ),
    "segment_search": _with(
        _POSTINGS.replace("CAST(e.user_id % 4 AS INTEGER) AS stream", "0 AS stream") + _search(["app", "title"], 200).replace("FROM ix JOIN hit", "FROM (SELECT * FROM ix WHERE date <> '2024-01-05') ix JOIN hit"),
        f"SELECT date, id, app, title, {_stamp('start_ms')} AS start, matched_terms FROM top",
    ),
}


def _walk_sql(depth: int, elements: int, children: int, lines: int) -> str:
    """The same walk, a level of all pages for each step of the recursion."""
    leaves, furniture, subtrees = "('image')", "('image', 'window', 'pane')", "('menubar', 'statusbar')"
    judged = f"""SELECT *, below OR kind IN {subtrees} AS under, CASE WHEN below OR kind IN {subtrees} OR kind IN {furniture} THEN 2 WHEN kind IN ('text', 'document') THEN 0 ELSE 1 END AS surface, trim(name) <> '' AS named"""
    return rf"""WITH RECURSIVE raw AS (
  SELECT page_id, i - 1 AS pos, shut[i] AS shut, tag[i] AS tag, name[i] AS name FROM (SELECT *, unnest(generate_series(1, len(tag))) AS i FROM (
    SELECT page_id, regexp_extract_all(coalesce(html, ''), '<(/?)([a-z][a-z0-9]*)[^<>]*>([^<]*)', 1) AS shut, regexp_extract_all(coalesce(html, ''), '<(/?)([a-z][a-z0-9]*)[^<>]*>([^<]*)', 2) AS tag, regexp_extract_all(coalesce(html, ''), '<(/?)([a-z][a-z0-9]*)[^<>]*>([^<]*)', 3) AS name FROM pages))
), deep AS (
  SELECT *, sum(CASE shut WHEN '/' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS d FROM raw WHERE tag NOT IN ('meta', 'br', 'img', 'link', 'input', 'hr')
), opened AS (SELECT * FROM deep WHERE shut = ''), el AS (
  SELECT o.page_id, o.pos, max(u.pos) AS parent, any_value(trim(o.name, ' ')) AS name, any_value(o.tag IN ('script', 'style')) AS hidden,
    any_value(CASE o.tag WHEN 'nav' THEN 'menubar' WHEN 'footer' THEN 'statusbar' WHEN 'aside' THEN 'pane' WHEN 'p' THEN 'text' WHEN 'h1' THEN 'document' WHEN 'li' THEN 'listitem' WHEN 'a' THEN 'hyperlink' WHEN 'b' THEN 'image' WHEN 'article' THEN 'window' ELSE 'group' END) AS kind
  FROM opened o LEFT JOIN opened u ON u.page_id = o.page_id AND u.d = o.d - 1 AND u.pos < o.pos GROUP BY o.page_id, o.pos
), kids AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, parent ORDER BY pos) AS nth FROM el WHERE parent IS NOT NULL) WHERE nth <= {children}),
w AS (
  SELECT * FROM (SELECT *, max(place) OVER (PARTITION BY page_id) AS seen, max(had + writes) OVER (PARTITION BY page_id) AS written FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place, coalesce(sum(writes) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM (
      SELECT *, CASE WHEN NOT hidden AND named AND surface = 0 THEN 1 ELSE 0 END AS writes FROM ({judged} FROM (SELECT page_id, pos, name, hidden, kind, 0 AS depth, FALSE AS below FROM el WHERE parent IS NULL)))) WHERE place <= {elements} AND had < {lines})
  UNION ALL
  SELECT * FROM (SELECT page_id, pos, name, hidden, kind, depth, below, under, surface, named, writes, place, had, max(place) OVER (PARTITION BY page_id) AS seen, max(had + writes) OVER (PARTITION BY page_id) AS written FROM (
    SELECT *, seen0 + row_number() OVER (PARTITION BY page_id ORDER BY after, pos) AS place, written0 + coalesce(sum(writes) OVER (PARTITION BY page_id ORDER BY after, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM (
      SELECT *, CASE WHEN NOT hidden AND named AND surface = 0 THEN 1 ELSE 0 END AS writes FROM ({judged} FROM (
        SELECT k.page_id, k.pos, k.name, k.hidden, k.kind, w.depth + CASE WHEN w.named THEN 1 ELSE 0 END AS depth, w.under AS below, w.place AS after, w.seen AS seen0, w.written AS written0
        FROM kids k JOIN w ON w.page_id = k.page_id AND w.pos = k.parent WHERE NOT w.hidden AND w.depth < {depth} AND w.kind NOT IN {leaves})))) WHERE place <= {elements} AND had < {lines})
)
SELECT page_id, CAST(pos AS INTEGER) AS node, CAST(place AS INTEGER) AS place, depth, surface, NOT hidden AS shown FROM w"""


ORACLES |= {
    "tree_walk": _walk_sql(4, 80, 24, 12),
    "tree_walk_narrow": _walk_sql(2, 12, 3, 4),
    # the clock of those years: an hour ahead from two in the morning of the first Sunday of April to two (one, again) of the last Sunday of October
    "hours_at_clock_changes": """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderdate IS NOT NULL), h AS (SELECT date, CAST(unnest(range(24)) AS INTEGER) AS hour FROM d),
      y AS (SELECT *, epoch_ms(CAST(date AS TIMESTAMP)) + hour * 3600000 AS wall, make_date(year(date), 4, 1) AS april, make_date(year(date), 10, 31) AS october FROM h),
      s AS (SELECT *, epoch_ms(CAST(april + CAST((7 - dayofweek(april)) % 7 AS INTEGER) AS TIMESTAMP)) + 7200000 AS ahead, epoch_ms(CAST(october - CAST(dayofweek(october) AS INTEGER) AS TIMESTAMP)) + 7200000 AS back FROM y)
      SELECT CAST(date AS VARCHAR) AS date, hour, CASE WHEN wall >= ahead AND wall < ahead + 3600000 THEN NULL WHEN wall >= back - 3600000 AND wall < back THEN NULL
        WHEN wall >= ahead AND wall < back THEN wall + 4 * 3600000 ELSE wall + 5 * 3600000 END AS start_ms FROM s""",
}

_ISO = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S.') || printf('%03dZ', {0} % 1000)"
_ONE_FULL = (_FULL + _POSTINGS[len(_FULL) :]).replace("CAST(e.user_id % 4 AS INTEGER) AS stream", "0 AS stream")
ORACLES |= {
    "stream_ingest_log": _with(_ACT, f"SELECT CAST(date AS VARCHAR) AS date, count(*) AS events, count(title) AS titles, {_ISO.format('max(ms)')} AS latest, TRUE AS few_batches, CAST(0 AS BIGINT) AS bad FROM act GROUP BY date"),
    "store_summaries": _with(
        _ROWS + _SLICES + _SUMS.split(",\nda AS")[0],
        "SELECT stream, date, hour, CASE WHEN hour % 5 = 1 THEN 'again' ELSE text END AS text, active_ms, CASE WHEN hour % 5 = 1 THEN 't2' ELSE 't1' END AS generated_at, 'p' AS provider, model FROM su WHERE hour % 7 <> 2 AND date <> '2024-01-05'",
    ),
    # of a day, stream 0 is saved first; the others follow by the time of saving, the last stream first
    "library_documents": _with(
        _ROWS + _DAYS + ",\nda AS" + _SUMS.split(",\nda AS")[1],
        """SELECT CAST(date AS VARCHAR) || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS id, 'Stream ' || stream AS title, CAST(date AS VARCHAR) AS date, CAST(date AS VARCHAR) || 'T0' || (9 - stream) || ':30:00.000Z' AS saved_at, '# Day' || chr(10) || chr(10) || daily AS body,
          CAST(date AS VARCHAR) || ' at 0' || (9 - stream) || ':30' AS label FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY stream <> 0, 9 - stream) AS n FROM da)""",
    ),
    "api_tools": _with(
        _ONE_FULL + _search(["app", "title"], 200),
        f""", shown AS (SELECT e.date, e.id, e.app, CASE WHEN NOT is_private THEN ht.title END AS title, is_private, start_ms FROM e LEFT JOIN ht ON ht.stream = e.stream AND ht.date = e.day AND ht.ep = e.ep)
        SELECT 'get_recent' AS tool, * FROM (SELECT date, id, app, title, is_private FROM shown WHERE date BETWEEN '2024-01-14' AND '2024-01-20' ORDER BY date DESC, start_ms DESC, id DESC LIMIT 200)
        UNION ALL SELECT 'search_history', date, id, app, CASE WHEN NOT is_private THEN title END, is_private FROM top
        UNION ALL SELECT 'get_today', date, id, app, title, is_private FROM shown WHERE date = '2024-01-20'
        UNION ALL SELECT 'status', '2024-01-20', (SELECT {_ISO.format('arg_max(ms, seq)')} FROM act WHERE date = '2024-01-20'), (SELECT count(DISTINCT date) || ' 0' FROM act), (SELECT CAST(count(*) AS VARCHAR) FROM act WHERE date = '2024-01-20'), FALSE""",
    ),
}
