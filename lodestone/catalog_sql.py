"""The catalog's questions in plain SQL, from the same rule pack. Each text is run by another engine to check results."""

from __future__ import annotations

import re

from .rules import LATIN

P = LATIN
_S = r"[\s\x0b\x1c-\x1f]"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _alt(words) -> str:
    return "|".join(re.escape(w) for w in words)


def strip(x):
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def clean(x):
    x = f"coalesce({x}, '')"
    return strip(rf"regexp_replace(regexp_replace(replace(replace({x}, chr(160), ' '), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def entities(x):
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x}, '&{name};', {_text(char)})"
    return x


def split_inline(x):
    return rf"regexp_replace({x}, '\s+((?:[0-9]{{1,2}}|[{P.numerals}]+)[.、）):：])', chr(10) || '\1', 'g')"


def normal(x):
    x = f"lower({x})"
    x = rf"regexp_replace({x}, '^(?:{_alt(w.lower() for w in (*P.rounds, *P.follow_ups))})[：:、\s-]*', '')"
    x = rf"regexp_replace({x}, '^[0-9{P.numerals}]+[.、)）:：\s-]+', '')"
    return f"regexp_replace({x}, '[^0-9a-z一-鿿]+', '', 'g')"


def bullets(x):
    return strip(rf"regexp_replace({x}, '^[\s>*#•·-]+', '')")


def has(x, words):
    return "(" + " OR ".join(f"contains({x}, {_text(w)})" for w in words) + ")"


def topic(x):
    scores = [" + ".join(f"CAST(contains(lower({x}), {_text(w)}) AS INT)" for w in words) for words in P.topics.values()]
    most = f"greatest({', '.join(scores)})"
    cases = " ".join(f"WHEN ({s}) = {most} THEN {_text(t)}" for s, t in zip(scores, P.topics))
    return f"CASE WHEN {most} = 0 THEN {_text(P.other_topic)} {cases} END"


def first_match(samples, table, default):
    cases = " ".join(f"WHEN {has(s, words)} THEN {_text(name)}" for s in samples for name, words in table.items())
    return f"CASE {cases} ELSE {_text(default)} END"


def company(title, text):
    title = rf"lower(regexp_replace(coalesce({title}, ''), '\s*[-—|]\s*{P.title_suffix}\s*$', ''))"
    return first_match([title, f"lower(substr(coalesce({text}, ''), 1, 600))"], P.companies, P.unknown_company)


def business(title, text):
    return first_match([f"lower(coalesce({title}, ''))", f"lower(substr(coalesce({text}, ''), 1, 500))"], P.businesses, P.unknown)


def date(x):
    found = f"regexp_extract_all(coalesce({x}, ''), '(?:^|[^0-9])(20[0-9]{{2}}[年./-][0-9]{{1,2}}[月./-][0-9]{{1,2}})', 1)"
    days = f"list_transform({found}, lambda d: try_strptime(regexp_replace(d, '[年月./]', '-', 'g'), '%Y-%m-%d'))"
    return f"coalesce(strftime(list_filter({days}, lambda d: d IS NOT NULL)[1], '%Y-%m-%d'), '')"


NETLOC = "lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1))"
PATH = "regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
SCHEME = "lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))"
IDENTITY = f"""CASE WHEN {has(NETLOC, P.known_hosts)} THEN platform || ':' || CASE WHEN {SCHEME} = '' THEN 'https' ELSE {SCHEME} END || '://' || {NETLOC} || rtrim({PATH}, '/')
    ELSE platform || ':' || url || '#' || title END"""
PROFILE = "CASE " + " ".join(f"WHEN contains({NETLOC}, {_text(part)}) THEN {_text(key)}" for key, (part, _) in P.profiles.items()) + " ELSE 'web' END"
LABEL = "CASE " + " ".join(f"WHEN contains({NETLOC}, {_text(part)}) THEN {_text(label)}" for part, label in P.profiles.values()) + f" ELSE {NETLOC} END"


def tags_off(x):
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>', '', 'g')"


DOCUMENTS = """SELECT d.doc_id AS ordinal, d.source AS platform, split_part(d.text, chr(10), 1) AS title, 'doc://' || d.doc_id AS url, d.text, d.lang AS business,
    CASE WHEN l.quality = 1 THEN 'A' WHEN l.quality = 0 THEN 'C' ELSE 'B' END AS confidence, coalesce(l.toxic, 0) = 0 AS is_complete
    FROM documents d LEFT JOIN labels l USING (doc_id)"""

LINES = f"""SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS line_no
    FROM (SELECT doc_id, {split_inline(clean(entities("text")))} AS t FROM documents) WHERE t <> ''"""

_LINE = rf"regexp_replace({bullets('raw')}, '^({_alt(P.rounds)})[：:]\s*', '\1：')"
CANDIDATES = f"""SELECT doc_id, line_no, line, {normal("line")} AS norm, substr(regexp_replace(line, '^[0-9{P.numerals}]+[.、)）]\\s*', ''), 1, 180) AS question
    FROM (SELECT doc_id, line_no, {_LINE} AS line FROM ({LINES}))
    WHERE length({normal("line")}) BETWEEN {P.shortest} AND {P.longest} AND NOT {has("line", P.noise)}
    AND (regexp_matches(line, '^[0-9{P.numerals}]+[.、)）:：]') OR regexp_matches(line, '[?？]\\s*$') OR {has("lower(line)", [h.lower() for h in P.hints])})"""

_OWN_BUSINESS = business("question", "''")
ROWS = f"""SELECT substr(sha1(platform || ':' || url || '#' || title), 1, 16) AS source_id, c.question, {normal("c.question")} AS norm, {topic("c.question")} AS topic, c.line_no, c.line,
    {company("p.title", "p.text")} AS company, CASE WHEN {_OWN_BUSINESS} = {_text(P.unknown)} THEN p.business ELSE {_OWN_BUSINESS} END AS business,
    p.platform, p.confidence, p.is_complete, p.title, p.url, p.ordinal, p.ordinal * 16777216 + c.line_no AS seq
    FROM ({CANDIDATES}) c JOIN ({DOCUMENTS}) p ON p.ordinal = c.doc_id"""

QUESTIONS = f"""WITH r AS (SELECT * FROM ({ROWS}) WHERE norm <> ''),
    k AS (SELECT norm, count(*) AS frequency, bool_and(NOT is_complete) AS poor FROM (SELECT *, row_number() OVER (PARTITION BY norm, source_id ORDER BY seq) AS n FROM r) WHERE n = 1 GROUP BY norm),
    a AS (SELECT norm, min(seq) AS first_seq, arg_min(question, seq) AS question, arg_min(topic, seq) AS topic, list_sort(list_distinct(list(company))) AS companies, list_sort(list_distinct(list(platform))) AS platforms,
        list_sort(list_distinct(list(business))) AS businesses, min(confidence) AS confidence FROM r GROUP BY norm),
    q AS (SELECT substr(sha1(a.norm), 1, 16) AS question_id, question, norm AS normalized, topic, frequency, frequency AS independent_source_count, confidence,
        round(greatest(0.0, least(1.0, CASE confidence WHEN 'A' THEN 0.90 WHEN 'B' THEN 0.72 ELSE 0.52 END::DOUBLE + least(0.10::DOUBLE, 0.03::DOUBLE * (frequency - 1)) - CASE WHEN poor THEN 0.08 ELSE 0.0 END::DOUBLE)), 2) AS quality_score,
        companies, platforms, businesses, first_seq FROM a JOIN k USING (norm)),
    s AS (SELECT substr(sha1(norm), 1, 16) AS question_id, * FROM (SELECT *, row_number() OVER (PARTITION BY norm, source_id ORDER BY seq) AS n FROM r) WHERE n = 1)"""

POST_COMPANY = f"CASE WHEN {company('title', 'text')} = {_text(P.unknown_company)} THEN {_text(P.unknown)} ELSE {company('title', 'text')} END"

_CJK = "regexp_replace(lower(t), '[^一-鿿]', '', 'g')"
_TERMS = f"list_concat(list_concat(regexp_extract_all(lower(t), '[a-z0-9+#.]{{2,}}'), list_transform(range(1, greatest(length({_CJK}), 1)), lambda i: substr({_CJK}, i, 2))), list_transform(range(1, greatest(length({_CJK}) - 1, 1)), lambda i: substr({_CJK}, i, 3)))"
_HEX = " + ".join(f"(instr('0123456789abcdef', substr(md5(term), {k}, 1)) - 1) * {w}" for k, w in ((1, 256), (2, 16), (3, 1)))
PATTERN = "license|erung"
SEARCH = f"""WITH d AS (SELECT doc_id AS ordinal, coalesce(text, '') AS t, CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.52 ELSE 0.72 END AS quality_score FROM documents LEFT JOIN labels USING (doc_id)),
    b AS (SELECT item_id AS query_id, text AS t FROM benchmark),
    dp AS (SELECT ordinal, term, count(*) AS tf FROM (SELECT ordinal, unnest({_TERMS}) AS term FROM d) GROUP BY ALL),
    bp AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_TERMS}) AS term FROM b) GROUP BY ALL),
    bn AS (SELECT query_id, count(*) AS n FROM bp GROUP BY ALL),
    lex AS (SELECT query_id, ordinal, sum(s) AS score FROM (
        SELECT query_id, ordinal, count(*)::DOUBLE / any_value(n) AS s FROM dp JOIN bp USING (term) JOIN bn USING (query_id) GROUP BY query_id, ordinal
        UNION ALL SELECT query_id, ordinal, 1.0 FROM b JOIN d ON contains(lower(d.t), lower(b.t))
        UNION ALL SELECT query_id, ordinal, 1.0 FROM b, d WHERE regexp_matches(d.t, '(?i){PATTERN}')) GROUP BY ALL),
    dv AS (SELECT ordinal, ({_HEX}) % 1024 AS dim, sum(tf) AS w FROM dp GROUP BY ALL),
    bv AS (SELECT query_id, ({_HEX}) % 1024 AS dim, sum(tf) AS w FROM bp GROUP BY ALL),
    dl AS (SELECT ordinal, sqrt(sum(w * w)) AS norm FROM dv GROUP BY ALL),
    bl AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM bv GROUP BY ALL),
    vec AS (SELECT query_id, ordinal, sum(dv.w * bv.w)::DOUBLE / (any_value(dl.norm) * any_value(bl.norm)) AS score FROM dv JOIN bv USING (dim) JOIN dl USING (ordinal) JOIN bl USING (query_id) GROUP BY query_id, ordinal)"""

EVENTS = """SELECT user_id AS run_id, 'web:url:' || json_extract_string(props, '$.k') AS item, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'finish' ELSE 'done' END AS kind, ts, event_id, event_type AS error FROM events"""
ITEMS = f"""SELECT run_id, item, bool_or(kind = 'done') AS done, arg_max(kind, (ts, event_id)) = 'failed' AS failed, CASE WHEN arg_max(kind, (ts, event_id)) = 'failed' THEN arg_max(error, (ts, event_id)) END AS error
    FROM ({EVENTS}) WHERE kind <> 'finish' GROUP BY run_id, item"""
REPLAY = f"""WITH i AS ({ITEMS}), p AS (SELECT run_id, count(*) FILTER (done) AS completed, count(*) FILTER (failed) AS failures FROM i GROUP BY ALL),
    l AS (SELECT run_id, arg_max(kind, (ts, event_id)) AS last, max(ts) AS updated FROM ({EVENTS}) GROUP BY run_id),
    s AS (SELECT run_id, CASE WHEN last <> 'finish' THEN 'running' WHEN coalesce(failures, 0) > 0 THEN 'partial' ELSE 'complete' END AS status, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated_at, updated,
        coalesce(completed, 0) AS completed, coalesce(failures, 0) AS failures FROM l LEFT JOIN p USING (run_id))"""

PAGES = f"""SELECT page_id, url, {NETLOC} AS host, {LABEL} AS platform, substr({clean(entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, 1, 160) AS title,
    {clean(entities("CASE WHEN len(parts) > 0 AND length(best) > 0 THEN best ELSE body END"))} AS text
    FROM (SELECT *, list_sort(list_transform(range(1, len(parts) + 1), lambda i: {{'n': -length(parts[i]), 'i': i, 'x': parts[i]}}))[1].x AS best, {tags_off("regexp_extract(html, '(?is)<body(?:\\s[^>]*)?>(.*?)</body>', 1)")} AS body
        FROM (SELECT *, list_transform(list_concat(regexp_extract_all(html, '(?is)<article(?:\\s[^>]*)?>(.*?)</article>', 1), regexp_extract_all(html, '(?is)<main(?:\\s[^>]*)?>(.*?)</main>', 1)), lambda x: {strip(tags_off("x"))}) AS parts FROM pages))"""

_BLOCK_CASE = """CASE WHEN contains(text, '验证码') OR contains(text, '安全验证') OR contains(lower(text), 'captcha') THEN '检测到验证码/安全验证，程序已停止当前平台，请手动处理后重新运行。'
    WHEN contains(text, '你访问的页面不见了') OR contains(text, '页面不见了') OR contains(text, '笔记不存在') OR contains(text, '当前笔记暂时无法浏览') THEN '笔记详情不可用或缺少有效的搜索上下文参数。'
    WHEN contains(text, '登录后') OR contains(text, '扫码登录') OR contains(text, '登录以查看更多') THEN '检测到登录页面。请在打开的浏览器中自行登录，登录态会保存在本地 profile。' END"""

SQL = {
    "post_scan": f"SELECT ordinal, platform, title, url, business, confidence, is_complete FROM ({DOCUMENTS})",
    "post_identity": f"SELECT page_id, {IDENTITY} AS identity, substr(sha1({IDENTITY}), 1, 16) AS source_id FROM (SELECT page_id, 'web' AS platform, url, 't' AS title FROM pages)",
    "post_latest": f"""SELECT identity, substr(sha1(identity), 1, 16) AS source_id, arg_min(url, (-length(text), page_id)) AS url, min(page_id) AS ordinal, CAST(max(length(text)) AS INT) AS n_text
        FROM (SELECT *, {IDENTITY} AS identity FROM ({PAGES})) GROUP BY identity""",
    "url_profile": f"SELECT page_id, {PROFILE} AS profile, {LABEL} AS label, string_split({PATH}, '/')[-1] AS note_id FROM pages",
    "urls_by_profile": f"SELECT {PROFILE} AS profile, count(*) AS n_urls, arg_min(url, page_id) AS first_url, sha1(string_agg(url, chr(10) ORDER BY page_id)) AS urls_sha1 FROM pages GROUP BY 1",
    "html_main_text": f"SELECT page_id, platform, title, text FROM ({PAGES})",
    "blocked_pages": f"""WITH p AS (SELECT *, {_BLOCK_CASE} AS message FROM ({PAGES})), f AS (SELECT host, min(page_id) AS since FROM p WHERE message IS NOT NULL GROUP BY host)
        SELECT page_id, host, CASE WHEN page_id > since THEN '同域名 ' || host || ' 已触发登录或验证阻断' WHEN message IS NOT NULL THEN message WHEN length(text) < 80 THEN '正文不足 80 字' END AS reason FROM p LEFT JOIN f USING (host)""",
    "clean_text": f"SELECT doc_id, {clean(entities('text'))} AS text FROM documents",
    "normalize_question": f"SELECT doc_id, line_no, {normal(bullets('raw'))} AS norm FROM ({LINES})",
    "inline_split": f"SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS n_lines, sha1(t) AS text_sha1 FROM (SELECT doc_id, {split_inline(clean(entities('text')))} AS t FROM documents)",
    "candidates": f"SELECT doc_id, question, 'text' AS evidence_type, line_no AS evidence_line, substr(line, 1, 240) AS evidence_excerpt FROM ({CANDIDATES})",
    "ocr_pages": f"""WITH c AS (SELECT conv_id, string_agg('[图片OCR 第' || (turn + 1) || '页]' || chr(10) || text, chr(10) ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id),
        l AS (SELECT conv_id, unnest(string_split(x, chr(10))) AS raw, generate_subscripts(string_split(x, chr(10)), 1) AS line_no FROM (SELECT conv_id, {split_inline(clean(entities('t')))} AS x FROM c)),
        m AS (SELECT conv_id, line_no, {bullets('raw')} AS line, try_cast(nullif(regexp_extract({bullets('raw')}, '^\\[图片OCR 第([0-9]+)页\\]$', 1), '') AS BIGINT) AS mark FROM l)
        SELECT conv_id, line_no, page, line FROM (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_no) AS page FROM m) WHERE mark IS NULL""",
    "topic_of": f"SELECT doc_id, {topic('text')} AS topic FROM documents",
    "infer_fields": f"SELECT ordinal, {company('title', 'text')} AS company, {business('title', 'text')} AS business, {date('text')} AS date FROM ({DOCUMENTS})",
    "question_frequency": f"""SELECT normalized, count(DISTINCT doc_id) AS frequency, substr(sha1(normalized), 1, 16) AS question_id FROM (SELECT doc_id, {normal(bullets('raw'))} AS normalized FROM ({LINES}))
        WHERE length(normalized) BETWEEN {P.shortest} AND {P.longest} GROUP BY normalized""",
    "cluster_exact": f"{QUESTIONS} SELECT question_id, question, normalized, topic, frequency, independent_source_count, confidence, quality_score, array_to_string(companies, '|') AS companies, array_to_string(platforms, '|') AS platforms, array_to_string(businesses, '|') AS businesses FROM q",
    "question_sources": f"{QUESTIONS} SELECT question_id, source_id, 'text' AS evidence_type, line_no AS evidence_line, substr(line, 1, 240) AS evidence_excerpt FROM s",
    "question_sources_join": f"{QUESTIONS} SELECT question_id, count(*) AS n_sources, min(url) AS first_url, max(title) AS last_title, count(DISTINCT platform) AS n_platforms FROM s GROUP BY question_id",
    "terms": f"{SEARCH} SELECT ordinal AS doc_id, term, tf FROM dp",
    "term_vectors": f"{SEARCH} SELECT query_id, CAST(dim AS INT) AS dim, CAST(w AS BIGINT) AS w FROM bv",
    "lexical_recall": f"{SEARCH} SELECT query_id, ordinal, round(score, 6) AS score FROM lex",
    "regex_recall": f"SELECT doc_id AS ordinal FROM documents WHERE regexp_matches(text, '(?i){PATTERN}')",
    "vector_recall": f"{SEARCH} SELECT query_id, ordinal, round(score, 6) AS score FROM vec",
    "hybrid_search": f"""{SEARCH}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal DESC) AS rank FROM lex WHERE score > 0),
        v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal DESC) AS rank FROM vec WHERE score > 0),
        f AS (SELECT query_id, ordinal, coalesce(1.0::DOUBLE / (60 + g.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0) AS rrf, g.rank AS gr, v.rank AS vr FROM g FULL JOIN v USING (query_id, ordinal)),
        o AS (SELECT query_id, ordinal, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, quality_score DESC, gr IS NULL, coalesce(gr, vr)) AS place FROM f JOIN d USING (ordinal))
        SELECT query_id, ordinal, CAST(place AS INT) AS place, round(rrf, 8) AS score FROM o WHERE place <= 20""",
    "dense_recall": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id AS ordinal, list_inner_product(d.v, q.v) AS score FROM e q, e d WHERE q.vec_id % 50 = 0)
        SELECT query_id, ordinal, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal DESC) AS rank FROM s) WHERE rank <= 10""",
    "run_items": ITEMS,
    "run_replay": f"{REPLAY} SELECT run_id, status, updated_at, completed, failures FROM s",
    "run_status": f"{REPLAY} SELECT run_id, status, updated_at, completed, failures FROM s ORDER BY updated DESC, run_id LIMIT 20",
    "pending_items": f"SELECT run_id, item FROM ({EVENTS}) GROUP BY ALL HAVING NOT bool_or(kind = 'done')",
    "session_done": f"SELECT run_id, bool_and(d) AS all_done FROM (SELECT run_id, item, bool_or(kind = 'done') AS d FROM ({EVENTS}) GROUP BY ALL) GROUP BY run_id",
    "resume_latest": f"{REPLAY} SELECT sha256(left(CAST(run_id AS VARCHAR), 1)) AS fingerprint, arg_max(run_id, updated_at || ' ' || lpad(CAST(run_id AS VARCHAR), 12, '0')) AS run_id, arg_max(status, updated_at || ' ' || lpad(CAST(run_id AS VARCHAR), 12, '0')) AS status FROM s WHERE status <> 'complete' GROUP BY 1",
    "keywords": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a|b|' || n_name ELSE n_name || ' 面经|' || n_name || ' 一面|' || n_name || ' 面试题' END AS keywords FROM nation",
    "stats": f"{QUESTIONS} SELECT (SELECT count(*) FROM q) AS questions, count(*) AS posts, count(DISTINCT platform) AS platforms, count(*) FILTER (confidence = 'A') AS high FROM ({DOCUMENTS})",
    "filter_options": f"{QUESTIONS} SELECT DISTINCT 'company' AS field, unnest(companies) AS value FROM q UNION SELECT 'topic', topic FROM q UNION SELECT DISTINCT 'platform', unnest(platforms) FROM q",
    "filter_questions": f"{QUESTIONS} SELECT question_id, question, frequency FROM q WHERE list_contains(companies, 'Apache') AND quality_score >= 0.7",
    "filter_posts": f"SELECT substr(sha1(platform || ':' || url || '#' || title), 1, 16) AS source_id, url FROM (SELECT *, {POST_COMPANY} AS company FROM ({DOCUMENTS})) WHERE company = 'Thing' AND platform = 'src1'",
    "question_cards": f"""{QUESTIONS}, t AS (SELECT question_id, string_agg(title || ' · 正文第 ' || line_no || ' 行', '|' ORDER BY seq) AS links FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq) AS k FROM s) WHERE k <= 3 GROUP BY question_id)
        SELECT question_id, CAST(round(quality_score * 100) AS INT) AS quality, CASE WHEN frequency > 1 THEN frequency || ' 个独立来源' ELSE '' END AS badge, array_to_string(companies[1:4], '|') AS companies, links, array_to_string(platforms, ' / ') AS platforms FROM q JOIN t USING (question_id)""",
    "post_cards": f"SELECT url, {POST_COMPANY} AS company, business, 'text · ' || CASE WHEN is_complete THEN '完整' ELSE '部分' END AS state, CASE WHEN {date('text')} = '' THEN '日期未记录' ELSE {date('text')} END AS date FROM ({DOCUMENTS})",
    "stream_status": "SELECT user_id AS run_id, count(*) FILTER (event_type <> 'error') AS done_marks, count(*) FILTER (event_type = 'error') AS failed_marks FROM events WHERE event_type <> 'purchase' GROUP BY user_id",
}
