"""Column functions on text: normal forms, tokens, sentences, dates, titles, tables, citations, refusals, containment.

All are JVM expressions. Lengths and positions are in code points. NULL in gives NULL out unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values of the evaluated answers' language -----------------------------------------------------------------------

#: Phrases any of which makes an answer a refusal.
REFUSAL_MARKERS = ("无法回答", "无法确定", "未形成决议", "未记载", "未提到", "没有提到", "缺少", "没有足够", "未能找到", "根据现有文档", "没有讨论", "未讨论")
#: Row labels that are sums.
TOTAL_LABELS = ("合计", "总计", "小计", "Total", "total", "合计:", "合计：")
#: Where a sentence ends, for text in Chinese; add "." for others.
SENTENCE_ENDS = "。！？!?；;\n"
#: Where a phrase ends when key points are cut.
PHRASE_ENDS = "\n，。；：、,;:!！?？)）(（|\"“”"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- normal forms --------------------------------------------------------------------------------------------------------


def squeeze(x: Column | str) -> Column:
    """Without any white space (Unicode); NULL becomes empty."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", "")


def phrase_form(x: Column | str) -> Column:
    """squeeze, and without the marks that exports put around phrases: @ _ \\ *."""
    return F.translate(squeeze(x), "@_\\*", "")


def visible(x: Column | str, kind: str = "mining") -> Column:
    """Without zero-width characters: 'mining' drops four kinds and trims, 'census' two kinds, 'layout' one."""
    drop = {"mining": "\u200b\u200c\u200d\ufeff", "census": "\u200b\ufeff", "layout": "\u200b"}[kind]
    out = F.translate(col(x), drop, "")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "") if kind == "mining" else out


def collapsed(x: Column | str, most: int = 120) -> Column:
    """White space collapsed to single spaces, trimmed, cut to a length."""
    return F.substring(F.trim(F.regexp_replace(col(x), r"(?U)\s+", " ")), 1, most)


# -- tokens and sentences -------------------------------------------------------------------------------------------------


def token_count(x: Column | str) -> Column:
    """The number of tokens() of a text, without an array of them."""
    return F.regexp_count(F.coalesce(col(x), F.lit("")), F.lit(r"[\p{L}\p{N}]+"))


def url_host(x: Column | str) -> Column:
    """The host of an address, lower-cased; NULL where there is none."""
    return F.lower(F.nullif(F.regexp_extract(col(x), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def usable_contexts(contexts: Column | str) -> Column:
    """Do recorded contexts begin with a numbered one; older records hold bare texts, and none is as good as none."""
    return F.coalesce(F.get(col(contexts), F.lit(0)).startswith("[1]"), F.lit(False))


def tokens(x: Column | str, bigrams: bool = False) -> Column:
    """Lower-cased runs of letters and digits; with bigrams, runs of Han characters become overlapping pairs."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if not bigrams:
        return words

    def parts(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
        return F.when(w.rlike(r"^\p{IsHan}{2,}$"), pairs).otherwise(F.array(w))

    return F.flatten(F.transform(words, parts))


def sentences(x: Column | str, ends: str = SENTENCE_ENDS) -> Column:
    """Pieces that end after one of the marks; blank pieces are dropped."""
    pieces = F.split(col(x), f"(?<=[{ends}])")
    return F.filter(pieces, lambda p: F.trim(squeeze(p)) != "")


# -- dates and titles ----------------------------------------------------------------------------------------------------------

#: The forms of dates that must be told.
DATE_IN_NAME = r"(20[0-9]{2})[年\-/.]?([0-9]{1,2})[月\-/.]?([0-9]{1,2})(?!周)"
WEEK_IN_NAME = r"(20[0-9]{2})年第?([0-9]{1,2})周"
DATES_IN_TEXT = (r"(20[0-9]{2})\s*[-/.]\s*([0-9]{1,2})\s*[-/.]\s*([0-9]{1,2})", r"(20[0-9]{2})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日")
PERIOD = r"(20[0-9]{2})(?:年第([0-9]{1,2})周|年([0-9]{1,2})月|年)"
HEAD_CHARS = 600


def _group(x: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))


def _day(x: Column, pattern: str) -> Column:
    """The first match as YYYY-MM-DD if month and day are in range; no calendar check."""
    y, m, d = (_group(x, pattern, i).cast("int") for i in (1, 2, 3))
    return F.when(m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d))


def week_date(year: Column, week: Column) -> Column:
    """Monday of an ISO week, held inside the year; NULL for weeks outside 1 to 53.

    The Monday of week 1 may lie in the year before: then 1 January. A year without a week 53 gives 31 December.
    """
    monday = F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), (week - 1) * 7)
    real = F.extract(F.lit("YEAROFWEEK"), monday) == year
    inside = F.when(F.year(monday) < year, F.make_date(year, F.lit(1), F.lit(1))).otherwise(monday)
    return F.when(week.between(1, 53), F.when(real, inside).otherwise(F.make_date(year, F.lit(12), F.lit(31))))


def week_in_name(x: Column | str) -> Column:
    c = F.coalesce(col(x), F.lit(""))
    return F.date_format(week_date(_group(c, WEEK_IN_NAME, 1).cast("int"), _group(c, WEEK_IN_NAME, 2).cast("int")), "yyyy-MM-dd")


def date_in_name(x: Column | str) -> Column:
    """A date in a file name or title, or else its week's."""
    c = F.coalesce(col(x), F.lit(""))
    return F.coalesce(_day(c, DATE_IN_NAME), week_in_name(c))


def date_in_text(x: Column | str) -> Column:
    """The first date of either form at the head of a text, or else in all of it."""
    c = F.coalesce(col(x), F.lit(""))
    head = F.substring(c, 1, HEAD_CHARS)
    return F.coalesce(*(_day(part, p) for part in (head, c) for p in DATES_IN_TEXT))


def normal_date(x: Column | str) -> Column:
    """Y-M-D as YYYY-MM-DD; anything else is NULL."""
    return _day(F.trim(col(x)), r"^(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})$")


def title_category(x: Column | str) -> Column:
    parts = F.split(col(x), "_")
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(0)))


def title_group(x: Column | str) -> Column:
    parts = F.split(col(x), "_")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1)))


def title_period(x: Column | str) -> Column:
    """yyyyWww, yyyy-mm or yyyy."""
    c = F.coalesce(col(x), F.lit(""))
    year, week, month = (_group(c, PERIOD, i) for i in (1, 2, 3))
    return F.when(week.isNotNull(), F.concat(year, F.lit("W"), F.lpad(week, 2, "0"))).when(month.isNotNull(), F.concat_ws("-", year, F.lpad(month, 2, "0"))).otherwise(year)


def title_topic(x: Column | str) -> Column:
    """Kind and last part of a title, without its period and item number."""
    c = F.coalesce(col(x), F.lit(""))
    parts = F.split(c, "_")
    n = F.size(parts)
    kind = F.when(n >= 3, F.get(parts, F.lit(1))).when(n == 2, F.get(parts, F.lit(0))).otherwise("")
    rest = F.when(n >= 3, F.array_join(F.slice(parts, 3, n), "_")).when(n == 2, F.get(parts, F.lit(1))).otherwise(c)
    rest = F.regexp_replace(F.regexp_replace(rest, PERIOD.replace("(20", "(?:20", 1), ""), "议题[0-9]+", "")
    tail = F.filter(F.split(rest, "[-/]"), lambda p: F.trim(p) != "")
    leaf = F.coalesce(F.trim(F.try_element_at(tail, F.lit(-1))), F.trim(rest))
    return F.when(kind != "", F.concat_ws("/", kind, leaf)).otherwise(leaf)


def title_subjects(x: Column | str, separators: str = r"[_\-/\s]+", least: int = 3) -> Column:
    """Distinct parts of a title of some length, the longest first, ties by text."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), separators), F.trim), lambda p: F.length(p) >= least))
    keyed = F.array_sort(F.transform(parts, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    return F.transform(keyed, lambda s: s["p"])


def short_name(x: Column | str) -> Column:
    """The last part of a title path."""
    parts = F.filter(F.split(F.coalesce(col(x), F.lit("")), "[_/]"), lambda p: F.trim(p) != "")
    return F.coalesce(F.trim(F.try_element_at(parts, F.lit(-1))), col(x))


# -- tables --------------------------------------------------------------------------------------------------------------------


def table_rows(x: Column | str) -> Column:
    """Cells of each |-line of a text; separator lines are dropped."""
    lines = F.filter(F.transform(F.split(col(x), r"\r\n|\r|\n"), F.trim), lambda s: s.startswith("|"))
    rows = F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(F.translate(c, "\u200b\ufeff", ""))))
    return F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike(r"^[-: ]*$")))


def first_number(cells: Column) -> Column:
    """The first cell after the label that holds a number and is no check mark; the patterns are fixed values."""
    rest = F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1)))
    return F.get(F.filter(rest, lambda c: c.rlike(r"[0-9]+(?:[.,][0-9]+)?") & ~c.rlike("^[√×✓]")), F.lit(0))


def plain_label(x: Column | str) -> Column:
    """Is a row label no label of a thing: a date, an ordinal or a total; the patterns are fixed values."""
    c = F.trim(col(x))
    return c.rlike(r"^(?:20[0-9]{2}[-/年.]|[0-9]{1,2}[-/月.]|20[0-9]{2}$)") | c.rlike(r"^[0-9]{1,3}$|^[一二三四五六七八九十]{1,3}$") | c.isin(*TOTAL_LABELS)


def table_line(cells: Column) -> Column:
    """| a | b |"""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))


# -- answers ---------------------------------------------------------------------------------------------------------------------


def is_refusal(x: Column | str, markers: tuple[str, ...] = REFUSAL_MARKERS) -> Column:
    c = col(x)
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(c, m))


def citations(x: Column | str) -> Column:
    """All n of [n], in order."""
    return F.transform(F.regexp_extract_all(col(x), F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda d: d.cast("long"))


def citations_valid(x: Column | str, contexts: Column) -> Column:
    """Are all citations between 1 and the number of contexts; NULL without any."""
    found = citations(x)
    return F.when(F.size(found) > 0, F.forall(found, lambda n: n.between(1, contexts)))


def contains_all(x: Column | str, wanted: Column, form=squeeze) -> Column:
    """Does a text hold every one of the strings, both in normal form. True for none."""
    c = form(x)
    return F.forall(wanted, lambda w: F.contains(c, form(w)))


def holds_in_order(wanted: Column | str, x: Column | str) -> Column:
    """Do the characters of a string occur in a text in that order, both without white space."""
    text, want = squeeze(x), squeeze(wanted)
    left = F.aggregate(
        F.split(want, ""),
        F.struct(text.alias("rest"), F.lit(True).alias("ok")),
        lambda acc, ch: F.struct(
            F.when(ch == "", acc["rest"]).otherwise(F.substring(acc["rest"], F.position(ch, acc["rest"]) + 1, F.length(acc["rest"]))).alias("rest"),
            (acc["ok"] & ((ch == "") | F.contains(acc["rest"], ch))).alias("ok"),
        ),
    )
    return left["ok"]


def phrases(x: Column | str, entity: Column | None = None, least: int = 8, most: int = 25, say: int = 6) -> Column:
    """Distinct phrases of a length between `least` and `most` that say something besides names, and hold the entity."""
    parts = F.transform(F.split(visible(x), f"[{PHRASE_ENDS}]".replace("|", r"\|")), squeeze)

    def good(p: Column) -> Column:
        ok = F.length(p).between(least, most) & (F.length(F.trim(F.regexp_replace(p, "@[一-龥]{2,4}", ""))) >= say)
        return ok & F.contains(p, squeeze(entity)) if entity is not None else ok

    return F.array_distinct(F.filter(parts, good))


def context_block(no: Column, doc: Column, page: Column, text: Column) -> Column:
    """A numbered context for a prompt."""
    where = F.when(page.isNotNull(), F.format_string("（%s 第%d页）", doc, page)).otherwise(F.format_string("（%s）", doc))
    return F.concat(F.format_string("[%d] ", no), where, F.lit("\n"), text)


def neighbours(chunk_id: Column | str) -> Column:
    """doc:n -> its neighbours doc:n-1 and doc:n+1, from 1; none if the tail is no number."""
    c = col(chunk_id)
    doc, n = F.regexp_extract(c, r"^(.*):([0-9]+)$", 1), _group(c, r"^(.*):([0-9]+)$", 2).cast("long")
    around = F.filter(F.array(n - 1, n + 1), lambda i: i >= 1)
    return F.when(n.isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.transform(around, lambda i: F.concat(doc, F.lit(":"), i.cast("string"))))


def content_id(x: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of a text or of bytes."""
    return F.substring(F.sha2(col(x), 256), 1, 16)


#: Namespace of name-based ids for URLs (RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(x: Column | str) -> Column:
    """Name-based UUID (version 5) in the URL namespace."""
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(col(x), "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def metric_key(name: Column, labels: Column) -> Column:
    """name{a="x",b="y"} with labels in order; the name alone without labels."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, name).otherwise(F.concat(name, F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def json_object(x: Column | str, schema: str) -> Column:
    """The outermost {...} of a reply, fence or prose around it ignored, parsed; NULL if it does not parse."""
    body = _group(F.coalesce(col(x), F.lit("")), r"(?s)(\{.*\})", 1)
    return F.from_json(body, schema)


def overlap_share(a: Column, b: Column) -> Column:
    """Share of box a (x0, y0, x1, y1) inside box b; areas are at least 1e-6."""
    w = F.greatest(F.lit(0.0), F.least(F.get(a, F.lit(2)), F.get(b, F.lit(2))) - F.greatest(F.get(a, F.lit(0)), F.get(b, F.lit(0))))
    h = F.greatest(F.lit(0.0), F.least(F.get(a, F.lit(3)), F.get(b, F.lit(3))) - F.greatest(F.get(a, F.lit(1)), F.get(b, F.lit(1))))
    area = (F.get(a, F.lit(2)) - F.get(a, F.lit(0))) * (F.get(a, F.lit(3)) - F.get(a, F.lit(1)))
    return w * h / F.greatest(area, F.lit(1e-6))
