"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions. Java's matcher gives no positions, but the parts between matches do: a match starts where the
parts and matches before it end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.llm.common import documents, unused, whole

#: Characters on either side of a span, up to the next match of its kind, in which context words count.
NEAR = 40
#: Elements of an array that are folded at once.
PART = 64
#: Points that a context word adds; points from which an added span counts; points from which a span is called confident.
CONTEXT, ENOUGH, CONFIDENT = 30, 50, 80


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of 1 to 19 digits passes: from the right, every second digit doubled, its digits summed."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes: its first four characters behind the rest, letters as 10 to 35, remainder 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    chars = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1)))
    return F.aggregate(chars, F.lit(0), add) == 1


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))


def _card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  #: as Java's matcher is to run it
    confirm: Callable[[Column], Column]
    points: int
    words: str  #: context words, whole ones
    hint: str  #: a string without which nothing can match, or ""
    base: bool


# Atomic forms of the plain patterns: what is given up is only backtracking that can't lead to a match, so that a long
# run of one class costs its length. A match starts at a run's first character or where the last match ended (\G).
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda v: F.lit(True), 80, "e?-?mails?|contacts?|write|address|kontakt|correo|courriel", "@", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", _octets, 60, "ip|ipv4|hosts?|hostname|servers?|address|login|serveur|servidor", ".", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 70, "cards?|visa|mastercard|credit|pay|paid|payments?|karte|kreditkarte|carte|tarjeta", "", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(9, 15), 60,
         "phones?|telephone|call|tel|mobile|fax|dial|anruf|anrufen|telefon|llamar|llame|telefono", "+", True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", mod97, 80, "iban|accounts?|bank|konto|compte|cuenta", "", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda v: ~v.rlike("^(000|666|9)") & ~v.rlike("-00-|-0000$"), 30,
         "ssn|social|security|insurance|taxpayer", "-", False),
)

_SPAN = "struct<s:int,k:int,e:int,kind:string,points:int>"


def _matched(text: Column, kind: Kind) -> tuple[Column, Column]:
    """The matches of a kind and the parts between them, one more."""
    found, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    if not kind.hint:
        return found, gaps
    some = F.contains(text, F.lit(kind.hint))
    return F.when(some, found).otherwise(F.array().cast("array<string>")), F.when(some, gaps).otherwise(F.array(text))


def running(df: DataFrame, arrays: Sequence[str], op: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with each of these columns, arrays of ints of 0 or more, replaced by ``op`` (a sum or a maximum) over the
    elements up to each.

    An array grows by being copied, so it is folded in parts of PART elements, whose totals, folded in parts too, tell
    where the next part starts. The cost grows with the array's length until it has some millions of elements. Each
    step is a projection of its own, so that no part is computed again for every element.
    """
    def parts(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(PART)), lambda i: F.slice(x, i, F.lit(PART)))

    def fold(x: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, empty, lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], v))).alias("out")), lambda acc: acc["out"])

    def within(x: str, ends: str) -> Column:
        """The parts of x, each from where the one before it ends."""
        return F.flatten(F.zip_with(parts(F.col(x)), F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends)), fold))

    low, high = ({x: unused(df, f"{x}{i}") for x in arrays} for i in (1, 2))
    for fine, coarse in (({x: x for x in arrays}, low), (low, high)):
        df = df.withColumns({coarse[x]: F.transform(parts(F.col(fine[x])), lambda p: F.aggregate(p, F.lit(0), lambda a, b: op(a, b))) for x in arrays})
    df = df.withColumns({high[x]: fold(F.col(high[x]), F.lit(0)) for x in arrays})
    df = df.withColumns({low[x]: within(low[x], high[x]) for x in arrays})
    return df.withColumns({x: within(x, low[x]) for x in arrays}).drop(*low.values(), *high.values())


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _lengths(found: Column, gaps: Column) -> Column:
    """Of each match, together with the part before it."""
    return F.transform(F.arrays_zip(found.alias("v"), F.slice(gaps, 1, F.size(found)).alias("b")), lambda r: F.length(r["b"]) + F.length(r["v"]))


def _confirmed(found: Column, gaps: Column, ends: Column, number: int, kind: Kind) -> Column:
    """The confirmed spans of a kind with their points."""
    n = F.size(found)
    # A gap that is shorter than NEAR is followed by a blank, a longer one by the character that stands there.
    before = lambda gap: F.right(F.concat(F.lit(" "), gap), F.lit(NEAR + 1))
    after = lambda gap: F.left(F.concat(gap, F.lit(" ")), F.lit(NEAR + 1))
    placed = F.transform(F.arrays_zip(found.alias("v"), F.slice(gaps, 1, n).alias("b"), F.slice(gaps, 2, n).alias("a"), ends.alias("e")), lambda r: F.struct(
        (r["e"] - F.length(r["v"])).alias("s"), r["e"].alias("e"), r["v"].alias("v"),
        F.concat(before(r["b"]), F.lit(" "), after(r["a"])).rlike(f"(?i)[^a-z0-9](?:{kind.words})[^a-z0-9]").alias("near")))
    points = lambda r: F.least(F.lit(100), kind.points + F.when(r["near"], CONTEXT).otherwise(0))
    good = F.filter(placed, lambda r: kind.confirm(r["v"]) & (F.lit(True) if kind.base else points(r) >= ENOUGH))
    spans = F.transform(good, lambda r: F.struct(r["s"].alias("s"), F.lit(number).alias("k"), r["e"].alias("e"), F.lit(kind.name).alias("kind"), points(r).alias("points")))
    return spans.cast(f"array<{_SPAN}>")


def personal_data(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with an array of spans (s, k, e, kind, points) by start and kind; s and e are code points, e exclusive.

    Spans of a kind don't overlap; those of different kinds may, and two kinds that start together are told apart by
    their order. Null and empty texts have none; repeated rows each have theirs, an empty table stays empty, and other
    columns stay whatever they are called, but for one called as ``spans``, which is replaced. Narrow, without a shuffle;
    a text's cost grows with its length, whatever it holds.
    """
    # In a step of their own, as each is used more than once and is dear.
    found, gaps, ends = ({k.name: unused(df, f"{what}_{k.name}") for k in KINDS} for what in ("found", "gaps", "ends"))
    matched = {name[k.name]: c for k in KINDS for name, c in zip((found, gaps), _matched(whole(text), k), strict=True)}
    placed = df.withColumns(matched).withColumns({ends[k.name]: _lengths(F.col(found[k.name]), F.col(gaps[k.name])) for k in KINDS})
    placed = running(placed, list(ends.values()), _sum)
    kinds = [_confirmed(F.col(found[k.name]), F.col(gaps[k.name]), F.col(ends[k.name]), i, k) for i, k in enumerate(KINDS)]
    return placed.withColumn(spans, F.array_sort(F.concat(*kinds))).drop(*matched, *ends.values())


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each run of overlapping spans of ``text`` replaced by its first span's kind in brackets, so nothing that
    any span covers is left. The text is cut anew for each run, so the cost grows with length times runs."""
    name = unused(df, "spans")
    marked = personal_data(df, text, name)
    spans, furthest = F.col(name), unused(df, "reach")
    marked = running(marked.withColumn(furthest, F.transform(spans, lambda r: r["e"])), [furthest], F.greatest)
    reach = F.col(furthest)
    # A span begins a run if those before it, which start no later, reach no further than its start.
    before = F.transform(F.arrays_zip(spans.alias("r"), F.concat(F.array(F.lit(0)), reach).alias("was")), lambda x: F.struct(x["r"]["s"].alias("s"), x["r"]["kind"].alias("kind"), x["was"].alias("was")))
    runs = F.filter(before, lambda r: r["s"] >= r["was"])
    head = F.array_join(F.transform(runs, lambda r: F.concat(F.substring(F.col(text), r["was"] + 1, r["s"] - r["was"]), F.lit("["), r["kind"], F.lit("]"))), "")
    tail = F.substring(F.col(text), F.coalesce(F.get(reach, F.size(reach) - 1), F.lit(0)) + 1, F.length(F.col(text)))
    return marked.withColumn(text, F.concat(head, tail)).drop(name, furthest)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", r["kind"], r["s"], r["e"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document. Repeated rows each get their row."""
    found = personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda r: r["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(n(k.name).alias(f"n_{k.name}") for k in KINDS),
        F.sha2(_joined(F.filter("spans", lambda r: r["k"] < sum(k.base for k in KINDS))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda r: r["points"] >= CONFIDENT)).cast("long").alias("n_confident"))


# The plain patterns and the same confirmations, for DuckDB.
_PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR lpad(ltrim(p, '0'), 3, '0') > '255')) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", """CASE WHEN length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 THEN
        list_sum(list_transform(range(1, length(regexp_replace(v, '[^0-9]', '', 'g')) + 1), lambda i:
          CASE WHEN i % 2 = 1 THEN substr(reverse(regexp_replace(v, '[^0-9]', '', 'g')), i, 1)::INT
               WHEN substr(reverse(regexp_replace(v, '[^0-9]', '', 'g')), i, 1)::INT > 4 THEN 2 * substr(reverse(regexp_replace(v, '[^0-9]', '', 'g')), i, 1)::INT - 9
               ELSE 2 * substr(reverse(regexp_replace(v, '[^0-9]', '', 'g')), i, 1)::INT END)) % 10 = 0 ELSE false END"""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
    "iban": (KINDS[4].pattern, """list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(replace(v, ' ', '')) + 1),
        lambda i: ascii(substr(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), i, 1))::BIGINT)),
        lambda r, c: CASE WHEN c < 58 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END) = 1"""),
    "ssn": (KINDS[5].pattern, "NOT regexp_matches(v, '^(000|666|9)') AND NOT regexp_matches(v, '-00-|-0000$')"),
}

_EACH = " UNION ALL ".join(f"""
SELECT rid, {i} AS k, '{kind.name}' AS kind, s, s + length(v) AS e, least(100, {kind.points} + CASE WHEN near THEN {CONTEXT} ELSE 0 END) AS points
FROM (SELECT rid, v, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s,
             regexp_matches(right(' ' || g[i], {NEAR + 1}) || ' ' || left(g[i + 1] || ' ', {NEAR + 1}), '(?i)[^a-z0-9](?:{kind.words})[^a-z0-9]') AS near
      FROM (SELECT rid, f, g, i, f[i] AS v FROM (SELECT rid, regexp_extract_all(text, '{_PLAIN[kind.name][0]}', 0) AS f, string_split_regex(text, '{_PLAIN[kind.name][0]}') AS g FROM texts),
            unnest(range(1, len(f) + 1)) u(i)))
WHERE {_PLAIN[kind.name][1]} AND {'true' if kind.base else f'{kind.points} + CASE WHEN near THEN {CONTEXT} ELSE 0 END >= {ENOUGH}'}""" for i, kind in enumerate(KINDS))

ORACLE = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_EACH})
SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS)},
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '') AS spans, count(*) FILTER (points >= {CONFIDENT}) AS n_confident
FROM texts LEFT JOIN spans USING (rid) GROUP BY rid, doc_id
"""

QUERIES = {"op2_pii": op2_pii}
ORACLES = {"op2_pii": ORACLE}
