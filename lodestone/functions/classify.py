"""Classification, identity and date rules as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import DEFAULT, RulePack
from .text import DIGIT, SPACES, _c, count_page_markers, drop_title_suffix, normalize_question, strip


def _has_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def looks_like_question(line, pack: RulePack = DEFAULT) -> Column:
    """5 to 130 normalised characters, no noise word, and numbered, or with a question mark or a hint.

    Only lines that pass the cheap tests are normalised.
    """
    line = _c(line)
    size = F.length(normalize_question(line, pack))
    numbered = line.rlike(f"^[{DIGIT}{pack.numerals}]+[.、)）:：]")
    asks = strip(line).endswith("?") | strip(line).endswith("？")
    hinted = _has_any(F.lower(line), [h.lower() for h in pack.hints])
    return (hinted | numbered | asks) & ~_has_any(line, pack.noise) & size.between(pack.shortest, pack.longest)


def topic_of(question, pack: RulePack = DEFAULT) -> Column:
    """Topic with most distinct keywords contained; the first in the pack on ties, none gives the other topic."""
    low = F.lower(_c(question))
    scores = [
        F.struct(sum((low.contains(w).cast("int") for w in words), F.lit(0)).alias("score"), F.lit(-k).alias("order"), F.lit(topic).alias("topic"))
        for k, (topic, words) in enumerate(pack.topics.items())
    ]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["topic"]).otherwise(pack.other_topic)


def _first_match(samples: list[Column], table: dict[str, tuple[str, ...]], default: str) -> Column:
    cases = [F.when(_has_any(sample, words), name) for sample in samples for name, words in table.items()]
    return F.coalesce(*cases, F.lit(default))


def infer_company(title, text, pack: RulePack = DEFAULT) -> Column:
    """First company named in the title, else in the first 600 characters of the text."""
    samples = [F.lower(drop_title_suffix(title, pack)), F.lower(F.substring(F.coalesce(_c(text), F.lit("")), 1, 600))]
    return _first_match(samples, pack.companies, pack.unknown_company)


def infer_business(title, text, pack: RulePack = DEFAULT) -> Column:
    """First business of the title, else of the first 500 characters of the text."""
    samples = [F.lower(F.coalesce(_c(title), F.lit(""))), F.lower(F.substring(F.coalesce(_c(text), F.lit("")), 1, 500))]
    return _first_match(samples, pack.businesses, pack.unknown)


def infer_date(text) -> Column:
    """First valid date with a year of this century, as YYYY-MM-DD, else empty."""
    pattern = f"(?<!{DIGIT})20[0-9]{{2}}[年./-][0-9]{{1,2}}[月./-][0-9]{{1,2}}"
    found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(pattern), 0)
    dates = F.transform(found, lambda d: F.try_to_timestamp(F.regexp_replace(d, "[年月./]", "-"), F.lit("yyyy-M-d")))
    return F.coalesce(F.date_format(F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0)), "yyyy-MM-dd"), F.lit(""))


_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _URL, 1))


def url_netloc(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _URL, 2))


def url_path(url) -> Column:
    """Path without parameters, query and fragment."""
    return F.regexp_replace(F.regexp_extract(_c(url), _URL, 3), ";[^/]*$", "")


def post_identity(platform, url, title, pack: RulePack = DEFAULT) -> Column:
    """Stable key of a source: the canonical address on known hosts, else address and title."""
    host = url_netloc(url)
    path = F.regexp_replace(url_path(url), "/+$", "")
    path = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    scheme = F.when(url_scheme(url) == "", "https").otherwise(url_scheme(url))
    canonical = F.concat(_c(platform), F.lit(":"), scheme, F.lit("://"), host, path)
    plain = F.concat(_c(platform), F.lit(":"), _c(url), F.lit("#"), _c(title))
    return F.when(_has_any(host, pack.known_hosts), canonical).otherwise(plain)


def short_id(text, size: int = 16) -> Column:
    return F.substring(F.sha1(_c(text)), 1, size)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of a task's parameters: sorted keys, no blanks, characters as they are, nulls written."""
    return F.to_json(F.struct(*[_c(fields[k]).alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def task_fingerprint(spec_json) -> Column:
    """sha256 of a task's canonical JSON (sorted keys, no blanks, characters unescaped)."""
    return F.sha2(_c(spec_json), 256)


def profile_key(url, pack: RulePack = DEFAULT) -> Column:
    host = url_netloc(url)
    return F.coalesce(*[F.when(host.contains(part), key) for key, (part, _) in pack.profiles.items()], F.lit("web"))


def platform_label(host, pack: RulePack = DEFAULT) -> Column:
    host = F.lower(_c(host))
    return F.coalesce(*[F.when(host.contains(part), label) for part, label in pack.profiles.values()], host)


#: fixed values: what a page shows instead of its text, in order of precedence
CAPTCHA = ("验证码", "安全验证")
MISSING = ("你访问的页面不见了", "页面不见了", "笔记不存在", "当前笔记暂时无法浏览")
LOGIN = ("登录后", "扫码登录", "登录以查看更多")
BLOCK_MESSAGES = {
    "captcha": "检测到验证码/安全验证，程序已停止当前平台，请手动处理后重新运行。",
    "missing": "笔记详情不可用或缺少有效的搜索上下文参数。",
    "login": "检测到登录页面。请在打开的浏览器中自行登录，登录态会保存在本地 profile。",
}


def page_blocked(text) -> Column:
    """Message why a page is blocked, or null."""
    text = _c(text)
    return (
        F.when(_has_any(text, CAPTCHA) | F.lower(text).contains("captcha"), BLOCK_MESSAGES["captcha"])
        .when(_has_any(text, MISSING), BLOCK_MESSAGES["missing"])
        .when(_has_any(text, LOGIN), BLOCK_MESSAGES["login"])
    )


def note_id(url) -> Column:
    """Last segment of the path."""
    return F.element_at(F.split(url_path(url), "/"), -1)


def completeness(text, expected, downloaded, used_ocr, pack: RulePack = DEFAULT) -> Column:
    """Struct of is_complete, collection_depth, confidence, ocr_page_count of a collected note."""
    pages = count_page_markers(text, pack)
    expected, downloaded, used = _c(expected), _c(downloaded), _c(used_ocr)
    whole = (expected == 0) | (used & (downloaded >= expected) & (pages >= expected))
    return F.struct(whole.alias("is_complete"), F.when(used, "deep").otherwise("text").alias("collection_depth"), F.when(used, "C").otherwise("B").alias("confidence"), pages.alias("ocr_page_count"))


def regex_hit(text, pattern: str) -> Column:
    """Whether a pattern occurs, letter case of any script ignored."""
    re.compile(pattern)
    return _c(text).rlike("(?iu)" + pattern)


def phrase_hit(text, query) -> Column:
    return F.lower(_c(text)).contains(F.lower(_c(query)))
