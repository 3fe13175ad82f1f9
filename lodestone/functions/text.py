"""Text rules as Column expressions. Regular-expression classes are spelled out where Python's differ from Java's."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..rules import DEFAULT, RulePack

#: what Python's \s and str.strip take as white space
SPACES = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: white space of the queries with SQL over flat pages
PLAIN_SPACES = r"\x09\x0a\x0c\x0d\x20"
#: what str.splitlines breaks at, beside CR LF and LF
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
DIGIT = r"\p{Nd}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def html_unescape(text) -> Column:
    """Entities of HTML 5. Only texts with an ampersand travel to Python."""
    text = _c(text)
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


#: references that the queries with SQL decode, in this order; each only where a semicolon closes it
CLOSED = (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def closed_entities(text) -> Column:
    """A few closed references decoded in the JVM; ``&amp`` without its semicolon, as at a cut title's end, stays."""
    out = _c(text)
    for name, char in CLOSED:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def characters(spaces: str) -> str:
    """The characters of a class as it is written here: ranges and code points."""
    return "".join(re.findall(f"[{re.sub(chr(92) * 2 + r'x{(.+?)}', lambda m: chr(int(m[1], 16)), spaces)}]", "".join(map(chr, range(0x3001)))))


def strip(text, spaces: str = SPACES) -> Column:
    """Without leading and trailing ``spaces``. A regular expression would be tried at every space of the text."""
    return F.btrim(_c(text), F.lit(characters(spaces)))


def clean_text(text, entities: bool = True, spaces: str = SPACES) -> Column:
    """Entities, NBSP, CR, blank runs and blank lines normalised, ``spaces`` stripped; null is empty."""
    text = F.coalesce(_c(text), F.lit(""))
    text = html_unescape(text) if entities else text
    text = F.translate(text, " \r", " \n")
    text = F.regexp_replace(text, "[ \\t]+", " ")
    return strip(F.regexp_replace(text, "\\n{3,}", "\n\n"), spaces)


def _any(words) -> str:
    return "|".join(re.escape(w) for w in words)


#: characters below U+0180 that a normal form drops
_DROPPED = "".join(map(chr, range(0x180))).translate(dict.fromkeys(b"0123456789abcdefghijklmnopqrstuvwxyz"))


def _letters(text: Column) -> Column:
    """Only 0-9, a-z and U+4E00..9FFF. What is ASCII once the common others are off needs no regular expression,
    which costs some 15 times as much a character. An array of one, so that ``rest`` is made once."""
    rest = F.array(F.translate(text, _DROPPED, ""))
    return F.transform(rest, lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(F.regexp_replace(x, "[^0-9a-z\\x{4e00}-\\x{9fff}]+", "")))[0]


def normalize_question(text, pack: RulePack = DEFAULT) -> Column:
    """Lower case, one leading round label and numbering off, only 0-9, a-z and U+4E00..9FFF kept."""
    out = F.lower(_c(text))
    out = F.regexp_replace(out, f"^(?:{_any(w.lower() for w in (*pack.rounds, *pack.follow_ups))})[：:、{SPACES}-]*", "")
    out = F.regexp_replace(out, f"^[{DIGIT}{pack.numerals}]+[.、)）:：{SPACES}-]+", "")
    return _letters(out)


def inline_split(text, pack: RulePack = DEFAULT) -> Column:
    """White space before an inline item number becomes a line break."""
    # the look behind comes after the first white space, else it would be made at every character
    return F.regexp_replace(_c(text), f"[{SPACES}](?<!^[{SPACES}])[{SPACES}]*(?=(?:{DIGIT}{{1,2}}|[{pack.numerals}]+)[.、）):：])", "\n")


def split_lines(text) -> Column:
    """Lines as str.splitlines gives them: no empty line after a final break, none in an empty text."""
    # by way of an array of one: named four times, the parts would be made four times
    plain = F.translate(F.replace(_c(text), F.lit("\r\n"), F.lit("\n")), OTHER_BREAKS, "\n" * len(OTHER_BREAKS))
    whole = F.array(F.split(plain, "\n", -1))
    return F.transform(whole, lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))[0]


def strip_bullets(line) -> Column:
    return strip(F.regexp_replace(_c(line), f"^[{SPACES}>*#•·-]+", ""))


def round_label(line, pack: RulePack = DEFAULT) -> Column:
    """A leading round label gets a full-width colon."""
    return F.regexp_replace(_c(line), f"^({_any(pack.rounds)})[：:][{SPACES}]*", "$1：")


def drop_numbering(line, pack: RulePack = DEFAULT) -> Column:
    return F.regexp_replace(_c(line), f"^[{DIGIT}{pack.numerals}]+[.、)）][{SPACES}]*", "")


def clean_public_title(title, host, entities: bool = True, spaces: str = SPACES) -> Column:
    """Title without a notification prefix where the host shows one, at most 160 characters."""
    title = clean_text(title, entities, spaces)
    plain = F.regexp_replace(title, f"^\\([^)]*(?:私信|消息)[^)]*\\)[{SPACES}]*", "")
    return F.substring(F.when(F.lower(_c(host)).contains("zhihu"), plain).otherwise(title), 1, 160)


def drop_title_suffix(title, pack: RulePack = DEFAULT) -> Column:
    return F.regexp_replace(F.coalesce(_c(title), F.lit("")), f"[{SPACES}]*[-—|][{SPACES}]*{re.escape(pack.title_suffix)}[{SPACES}]*$", "")


#: fixed values: what follows the article on one host
ARTICLE_ENDS = ("\n提示\n订阅专刊", "\n全部评论", "\n相关推荐", "\n暂无评论")


def cut_at_markers(text, markers=ARTICLE_ENDS) -> Column:
    out = _c(text)
    for m in markers:
        out = F.substring_index(out, m, 1)
    return out


def count_page_markers(text, pack: RulePack = DEFAULT) -> Column:
    mark = pack.page_marker[0]
    text = F.coalesce(_c(text), F.lit(""))
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def _grams(text: Column, n: int) -> Column:
    many = F.length(text) - (n - 1)
    every = F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(many >= 1, every).otherwise(F.array().cast("array<string>"))


def terms(text) -> Column:
    """Latin tokens of two or more characters, then 2-grams and 3-grams of the CJK characters alone."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9+#.]{2,}"), 0)
    cjk = F.regexp_replace(low, "[^\\x{4e00}-\\x{9fff}]", "")
    grams = [_grams(cjk, n) for n in (2, 3)]
    return F.concat(latin, *grams)


def haystack(question, topic, companies, businesses) -> Column:
    """Searched text: question, topic, companies, businesses joined by a space (a missing topic is empty)."""
    return F.concat_ws(" ", _c(question), F.coalesce(_c(topic), F.lit("")), _c(companies), _c(businesses))


def _quoted(text, blank: str, safe: str = "") -> Column:
    """Percent-encoding as Python has it, from the built-in form encoding."""
    out = F.replace(F.replace(F.url_encode(_c(text)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    for c in safe:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.replace(out, F.lit("+"), F.lit(blank))


def note_url(note_id, token) -> Column:
    """Address of a note with its search token."""
    return F.concat(F.lit("https://www.xiaohongshu.com/explore/"), _c(note_id), F.lit("?xsec_token="), _quoted(token, "+"), F.lit("&xsec_source=pc_search"))


def search_url(keyword) -> Column:
    return F.concat(F.lit("https://www.xiaohongshu.com/search_result?keyword="), _quoted(keyword, "%20", "/"), F.lit("&type=51"))
