"""Scalar functions as Column expressions: text, URLs, numbers, dates. All run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _decomposed() -> tuple[str, str]:
    """Characters that decompose into one character and nonspacing marks, and those characters; then the marks, which go.

    By the Unicode tables, so every script counts. Hangul syllables, which decompose into several letters, stay whole.
    """
    whole, base, marks = [], [], []
    for code in (*range(0x80, 0xAC00), *range(0xF900, 0x1F000)):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif (parts := unicodedata.normalize("NFD", c)) != c:
            rest = [p for p in parts if unicodedata.category(p) != "Mn"]
            if len(rest) == 1:
                whole.append(c)
                base.append(rest[0])
    return "".join(whole + marks), "".join(base)


def unmarked(x: Column) -> Column:
    """NFD without nonspacing marks."""
    return F.translate(x, *_decomposed())


def norm(x: Column) -> Column:
    """Lower case without accents, untrimmed."""
    return unmarked(F.lower(x))


def trimmed_norm(x: Column) -> Column:
    return norm(F.trim(x))


def slug(x: Column) -> Column:
    """Accents and quotes away, runs of other than a-z and 0-9 to one hyphen, none at the ends."""
    plain = F.regexp_replace(unmarked(x), "['`‘’]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-|-$", "")


def title_key(x: Column) -> Column:
    """ASCII only, punctuation to spaces, spaces collapsed."""
    ascii_ = F.lower(F.regexp_replace(unmarked(x), r"[^\x00-\x7F]", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_, r"[^a-z0-9\s]", " "), r"\s+", " "))


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]+>", "")


def visible_text(html: Column) -> Column:
    """Scripts, styles and tags, empty ones too, to spaces; four entities decoded in this order; white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def words(x: Column) -> Column:
    """How many; an empty text has none."""
    t = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def clean_title(x: Column, most: int = 300) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")), 1, most)


def json_fence(x: Column) -> Column:
    """The inside of a fenced block, or the whole text, trimmed."""
    fenced = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
    return F.trim(F.when(x.rlike(fenced), F.regexp_extract(x, fenced, 1)).otherwise(x))


def csv_guard(x: Column) -> Column:
    """An apostrophe before what a spreadsheet would take for a formula."""
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def html_escape(x: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def script_escape(json: Column) -> Column:
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))


def url_id(url: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(url, F.lit("")), 256), 1, 16)


def safe_scheme(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), F.lit(False))


def canonical_url(url: Column) -> Column:
    """Without utm_ parameters; the others are decoded and encoded anew, grouped by name in the order in which names first
    come. Without a query the address stays as it is; a fragment stays behind the query."""
    parts = F.split(F.regexp_extract(url, "^[^#]*", 0), r"\?", 2)
    fragment = F.regexp_extract(url, "#.*$", 0)
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(F.lit(""))).alias("v"))
    pairs = F.transform(F.filter(F.split(F.get(parts, 1), "&"), lambda p: p != ""), pair)
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_"))
    names = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    grouped = F.flatten(F.transform(names, lambda n: F.filter(kept, lambda p: p["k"] == n)))
    query = F.array_join(F.transform(grouped, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    whole = F.concat(F.get(parts, 0), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), fragment)
    return F.when((F.size(parts) < 2) | (F.get(parts, 1) == ""), url).otherwise(whole)


def locale_number(x: Column) -> Column:
    """1.154,35 as 1154.35; markers of missing values, and anything else, as null."""
    t = F.trim(x)
    plain = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(t.isin("", "-", "S/I", "N/A"), None).otherwise(plain.try_cast("double"))


def locale_text(x: Column, decimals: int = 1) -> Column:
    """1,234.5 as 1.234,5"""
    return F.translate(F.format_number(x, decimals), ",.", ".,")


def js_round(x: Column) -> Column:
    """Halves upwards."""
    return F.floor(x + 0.5).cast("long")


def even_round(x: Column, digits: int = 0) -> Column:
    """Halves to even."""
    return F.bround(x, digits)


def per_100k(count: Column, population: Column) -> Column:
    return F.when(population > 0, count * 1e5 / population)


def signed_pct(x: Column, mean: Column) -> Column:
    return F.when(mean != 0, (x - mean) * 100 / mean)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def region_of(cut: Column) -> Column:
    """The first two digits of five, else the first."""
    return F.when(F.length(cut) == 5, F.substring(cut, 1, 2)).otherwise(F.substring(cut, 1, 1))


def unpad(code: Column) -> Column:
    return F.coalesce(code.try_cast("int").cast("string"), code)


def iso_date(x: Column) -> Column:
    """Exactly YYYY-MM-DD, else null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date"))


def trend(change_pct: Column, threshold: float = 5.0) -> Column:
    return F.when(change_pct > threshold, "up").when(change_pct < -threshold, "down").otherwise("stable")


def interpolate(template: Column, values: dict[str, Column]) -> Column:
    """{key} by its value; unknown keys stay."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v.cast("string"))
    return template


# Fixed values.
MONTHS_ES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
REGION_PLAIN, REGION_DEL = ("Metropolitana",), ("Maule", "Biobío")
FORBIDDEN_NAMES = ("safest", "most dangerous", "safe", "dangerous")


def citation(outlet: Column, date: Column, title: Column, url: Column) -> Column:
    """Outlet. (year, day de month). Title. Address - with "s. a." for a missing outlet and "(s. f.)" for a date that isn't one."""
    head = F.substring(F.coalesce(date, F.lit("")), 1, 10)
    day = F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(head, F.lit("yyyy-M-d")).cast("date"))
    said = F.concat(F.lit("("), F.year(day), F.lit(", "), F.dayofmonth(day), F.lit(" de "), F.element_at(F.array(*map(F.lit, MONTHS_ES)), F.month(day)), F.lit(")"))
    who = F.trim(F.coalesce(outlet, F.lit("")))
    return F.concat(F.when(who != "", F.concat(who, F.lit(". "))).otherwise("s. a. "), F.coalesce(said, F.lit("(s. f.)")), F.lit(". "),
                    F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(url, F.lit("")))


def region_phrase(name: Column) -> Column:
    """The Spanish phrase for a region, with del, de or neither."""
    link = F.when(name.isin(*REGION_PLAIN), " ").when(name.isin(*REGION_DEL), " del ").otherwise(" de ")
    return F.concat(F.lit("Región"), link, name)


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1))


def without_space(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", "")


def label(code: Column, names: dict[str, str]) -> Column:
    """A code's name, or the code."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), code) if pairs else code


def short_number(x: Column) -> Column:
    """1,234.5 and 1,234: groups of thousands and one decimal place, if it isn't 0."""
    return F.regexp_replace(F.format_number(F.floor(F.abs(x) * 10 + 0.5) / 10 * F.signum(x), 1), r"\.0$", "")


def band_label(low: Column, high: Column) -> Column:
    """low + 1 – high, from 0 where there is no lower break; without an upper one low+. Breaks count as whole numbers."""
    first = F.when(low.isNull(), 0).otherwise(low + 1)
    number = lambda v: F.format_number(js_round(v), 0)
    return F.when(high.isNull(), F.concat(number(first), F.lit("+"))).otherwise(F.concat(number(first), F.lit(" – "), number(high)))


def marked_match(name: Column, query: str) -> Column:
    """(head, match, tail) of a name around the first place of the query, without accents and case; all head without one."""
    q = norm(F.trim(F.lit(query)))
    at = F.when(q == "", 0).otherwise(F.instr(norm(name), q))
    long_ = F.lit(2**31 - 1)
    return F.struct(F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(name).alias("head"),
                    F.when(at > 0, F.substring(name, at, F.length(q))).otherwise("").alias("match"),
                    F.when(at > 0, F.substring(name, at + F.length(q), long_)).otherwise("").alias("tail"))


def leading_json(x: Column) -> Column:
    """The object or array at the start of a text, up to its closing bracket; null if there is none.

    Brackets inside of strings don't count: strings are blanked out first, in place.
    """
    t = F.trim(json_fence(x))
    blank = F.regexp_replace(t, r'\\.', "__")
    strings = F.split(blank, '"')
    flat = F.array_join(F.transform(strings, lambda s, i: F.when(i % 2 == 0, s).otherwise(F.repeat(F.lit("_"), F.length(s)))), "_")
    step = lambda acc, c: F.struct((acc["at"] + 1).alias("at"), (acc["depth"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("depth"),
                                   F.when((acc["end"] == 0) & (acc["depth"] == 1) & c.isin("}", "]"), acc["at"] + 1).otherwise(acc["end"]).alias("end"))
    done = F.aggregate(F.split(flat, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end")), step)
    return F.when(t.rlike(r"^[{\[]") & (done["end"] > 0), F.substring(t, F.lit(1), done["end"]))


def pair_envelope(one: Column, other: Column, names: tuple[str, str] = ("titular_a", "titular_b")) -> Column:
    """Two cleaned titles as one JSON object."""
    return F.to_json(F.struct(clean_title(one).alias(names[0]), clean_title(other).alias(names[1])))


def neutral_name(name: Column) -> Column:
    """The name, or an error where it has one of the words that a list's name must not have."""
    bad = F.lower(name).rlike("|".join(FORBIDDEN_NAMES))
    return F.when(~bad | name.isNull(), name).otherwise(F.raise_error(F.concat(F.lit("forbidden word in list name: "), name)))


def _blocked_quad(a: Column, b: Column, c: Column) -> Column:
    """Private, local, reserved and multicast IPv4 addresses by their first three bytes."""
    return (a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
            | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)))


def _of(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it uses many times and that is computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def ipv6_groups(host: Column) -> Column:
    """The eight numbers of an IPv6 literal in lower case, however it is written; null if it is none."""
    def flat(h: Column) -> Column:
        """With an IPv4 address at its end as two groups."""
        quad = F.transform(F.split(F.regexp_extract(h, r"(?:^|:)(\d{1,3}(?:\.\d{1,3}){3})$", 1), r"\."), lambda x: x.try_cast("int"))
        pair = lambda q, i: F.lower(F.hex(F.get(q, i) * 256 + F.get(q, i + 1)))
        tail = _of(quad, lambda q: F.when(F.forall(q, lambda x: x.between(0, 255)), F.concat(pair(q, 0), F.lit(":"), pair(q, 2))))
        return F.when(~F.contains(h, F.lit(".")), h).otherwise(F.concat(F.regexp_extract(h, r"^(.*:)[^:]*$", 1), tail))

    def words(sides: Column) -> Column:
        part = lambda i: F.when(F.get(sides, i) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(sides, i), ":"))
        gap = 8 - F.size(part(0)) - F.size(part(1))
        return F.when((F.size(sides) == 2) & (gap >= 1), F.concat(part(0), F.array_repeat(F.lit("0"), gap), part(1))).when((F.size(sides) == 1) & (F.size(part(0)) == 8), part(0))

    numbers = lambda ws: F.when(F.forall(ws, lambda w: w.rlike("^[0-9a-f]{1,4}$")), F.transform(ws, lambda w: F.conv(w, 16, 10).cast("int")))
    return _of(_of(_of(_of(host, flat), lambda f: F.split(f, "::")), words), numbers)


def safe_to_fetch(url: Column) -> Column:
    """http or https, a host, no user in it, and no address literal of a private, local, reserved or multicast range.

    IPv6 literals are read in all their forms; of them those in 2000::/3 pass, but for the ranges for tunnels and documents, and IPv4
    ones mapped into IPv6 as IPv4 ones do. Numbers that resolvers take for IPv4 addresses - one number, hexadecimal or octal
    ones, fewer than four - don't pass, nor do localhost and what lies under it. Other names aren't resolved here: see
    ``fetching.safe_address``, which is asked at the time of the fetch.
    """
    def name(host: Column) -> Column:
        number = r"(0|[1-9]\d{0,2})"
        quad = F.transform(F.split(F.when(host.rlike(rf"^{number}(\.{number}){{3}}$"), host), r"\."), lambda x: x.try_cast("int"))
        open_ = _of(quad, lambda q: F.forall(q, lambda x: x <= 255) & ~_blocked_quad(F.get(q, 0), F.get(q, 1), F.get(q, 2)))
        plain = (host != "") & ~host.rlike(r"(^|\.)localhost$") & ~F.contains(host, F.lit(":"))
        return F.when(host.rlike(r"^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+)){0,3}$"), F.coalesce(open_, F.lit(False))).otherwise(plain)

    def literal(g: Column) -> Column:
        at = [F.get(g, i) for i in range(8)]
        mapped = F.forall(F.slice(g, 1, 5), lambda x: x == 0) & (at[5] == 0xFFFF)
        special = ((at[0] == 0x2001) & ((at[1] < 0x200) | (at[1] == 0xDB8))) | (at[0] == 0x2002) | ((at[0] == 0x3FFF) & (at[1] < 0x1000))
        return F.when(mapped, ~_blocked_quad(F.floor(at[6] / 256), at[6] % 256, F.floor(at[7] / 256))).otherwise(at[0].between(0x2000, 0x3FFF) & ~special)

    def host(auth: Column) -> Column:
        six = _of(ipv6_groups(F.regexp_extract(auth, r"^\[([^\]]*)\](?::\d*)?$", 1)), literal)
        other = _of(F.regexp_replace(F.regexp_replace(auth, r":\d*$", ""), r"\.$", ""), name)
        return ~F.contains(auth, F.lit("@")) & F.when(auth.startswith("["), six).otherwise(other)

    auth = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1))
    return F.coalesce(safe_scheme(url) & _of(auth, host), F.lit(False))


def cut_bytes(x: Column, most: int) -> Column:
    """The longest start of a text that has at most ``most`` bytes of UTF-8."""
    data = F.encode(x, "UTF-8")
    # A character is cut if the byte behind the limit continues it; it has at most 4 bytes.
    back = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(None).cast("int"), lambda acc, i: F.when(
        acc.isNotNull() | ((F.conv(F.hex(F.substring(data, F.lit(most + 2) - i, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.lit(0xC0))) == 0x80), acc).otherwise(i - 1))
    return F.when(F.octet_length(x) <= most, x).otherwise(F.decode(F.substring(data, F.lit(1), F.lit(most) - F.coalesce(back, F.lit(0))), "UTF-8"))


def date_or(x: Column, default: Column) -> Column:
    return F.coalesce(iso_date(x), default)


def region_file(region: Column) -> Column:
    """1 to 16 as they are, else the old code's tens."""
    n = region.cast("int")
    return F.when(n.between(1, 16), n).otherwise(F.floor(n / 10)).cast("string")


MONTHS_EN = "January February March April May June July August September October November December".split()


def month_label(month: Column, language: str = "en") -> Column:
    """August 2024, or agosto de 2024, of 2024-08; what is no month stays as it is."""
    names = F.array(*map(F.lit, MONTHS_EN if language == "en" else MONTHS_ES))
    n = F.regexp_extract(month, r"^\d{4}-(\d{2})", 1).try_cast("int")
    said = F.concat(F.get(names, n - 1), F.lit(" " if language == "en" else " de "), F.substring(month, 1, 4))
    return F.when(n.between(1, 12), said).otherwise(month)


def day_label(day: Column, newest_year: Column | None = None) -> Column:
    """Aug 5 of 2024-08-05; with ``newest_year`` a day of another year has its own behind it: Aug 5, 2023. What is no day
    stays as it is."""
    date = iso_date(day)
    said = F.concat(F.substring(F.get(F.array(*map(F.lit, MONTHS_EN)), F.month(date) - 1), 1, 3), F.lit(" "), F.dayofmonth(date).cast("string"))
    if newest_year is not None:
        said = F.when(F.year(date).cast("string") == newest_year.cast("string"), said).otherwise(F.concat(said, F.lit(", "), F.year(date).cast("string")))
    return F.when(date.isNotNull(), said).otherwise(day)
