"""Redaction of personal data and secrets by ordered patterns, in the JVM.

Each pattern sees the text as the one before left it. The steps are a chain of columns, one projection each: nested in
one expression, text and counts would repeat all steps before, and the plan would grow with the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import CATEGORIES, COUNTED_AS, IP_PLACEHOLDER, IPV4, ORG_DOMAIN, SAFE_DOMAINS, SCRUB_PATTERNS, VERSION_REACH, VERSION_WORDS


def ip_pattern() -> str:
    """IPv4 addresses that no version word precedes. A look-behind's width is bounded, so each word leaves the rest of VERSION_REACH to white space.

    The cheap look-ahead in front keeps the look-behind from being tried at every character.
    """
    words = "|".join(rf"(?i:{w.replace('.', chr(92) + '.')})\s{{0,{VERSION_REACH - len(w)}}}" for w in VERSION_WORDS)
    return rf"(?=\d{{1,3}}\.)(?<![.\d])(?<!{words}){IPV4}(?![.\d])"


STEPS = [*((COUNTED_AS.get(c, c), p, to) for c, p, to in SCRUB_PATTERNS), ("network", ip_pattern(), IP_PLACEHOLDER)]


#: For each step, texts of which a match holds one; none where a match holds no fixed text. Most texts hold none of them, and a search for
#: a fixed text costs a small part of a pattern's.
NEEDLES = (
    ("/home/",), ("/Users/",), ("C:\\Users\\",), ("~/",), ("sk-",), ("ghp_",), ("glpat-",), ("AKIA",), ("eyJ",), ("Bearer",), ("token",),
    (".internal", ".local", ".corp", ".lan"), (), ("@",), (), ("-----BEGIN ",), ("ssh-",), ("://",), ("Server=",), (".",),
)


def _may_match(i: int, text: Column) -> Column:
    """Whether step i can match at all."""
    held = [F.contains(text, F.lit(x)) for x in NEEDLES[i]]
    out = held[0] if held else text.isNotNull()
    for x in held[1:]:
        out = out | x
    return out


def scrub(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `text` redacted and a column `{category}_redacted` of counts for each category; a null text stays null and counts 0."""
    sums: dict[str, list[Column]] = {c: [] for c in CATEGORIES}
    keep = df.columns
    for i, (category, pattern, to) in enumerate(STEPS):
        own = F.lit(f"(?U){pattern}")
        df = df.withColumn(f"_n{i}", F.when(_may_match(i, F.col(text)), F.regexp_count(text, own)).otherwise(F.lit(0)))
        df = df.withColumn(text, F.when(F.col(f"_n{i}") > 0, F.regexp_replace(text, own, F.lit(to))).otherwise(F.col(text)))
        sums[category].append(F.col(f"_n{i}"))
    return df.select(*keep, *(sum(v[1:], v[0]).cast("int").alias(f"{c}_redacted") for c, v in sums.items()))


def scrub_lists(df: DataFrame, lists: str) -> DataFrame:
    """As scrub(), in place for a column of lists of lists of texts; counts are those of a row.

    Filters that follow must not be merged into the steps, where each mention of a step repeats all steps before. Spark
    pushes no filter below a column that isn't a function of its row, as the row number in the last condition, always
    true, makes this one.
    """
    sums: dict[str, list[Column]] = {c: [] for c in CATEGORIES}
    keep = df.columns

    def step(i: int, pattern: str, to: str) -> tuple[Callable[[Column, Column], Column], Callable[[Column], Column]]:
        own = F.lit(f"(?U){pattern}")
        count = lambda n, x: n + F.when(_may_match(i, x), F.regexp_count(x, own)).otherwise(F.lit(0))
        clean = lambda x: F.when(_may_match(i, x), F.regexp_replace(x, own, F.lit(to))).otherwise(x)
        return count, lambda texts: F.transform(texts, clean)

    for i, (category, pattern, to) in enumerate(STEPS):
        count, clean = step(i, pattern, to)
        df = df.withColumns({f"_n{i}": F.aggregate(F.flatten(lists), F.lit(0), count), lists: F.transform(lists, clean)})
        sums[category].append(F.col(f"_n{i}"))
    done = F.struct(F.col(lists), *(sum(v[1:], v[0]).cast("int").alias(f"{c}_redacted") for c, v in sums.items()))
    return df.select(*(c for c in keep if c != lists), F.when(F.monotonically_increasing_id() >= 0, done).alias("_done")).select("*", "_done.*").drop("_done")


def org_domains(text: Column) -> Column:
    """Domains of organisations in order of appearance, but for well-known ones."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"(?U){ORG_DOMAIN}"), F.lit(0)), lambda d: ~F.lower(d).isin(*SAFE_DOMAINS))


_REDACTION = "array<struct<start: int, end: int, original: string>>"


def _placed(text: str, pattern: Column) -> Column:
    """(start, end, original) of each match in order, in characters from 0: running lengths of the matches and of what lies between them.

    What lies between is found by a split at the same pattern, so both have the same matches: one piece more than these.
    """
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(F.col(text), pattern, -1)
    put = lambda acc, x: F.struct(
        (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["m"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.char_length(x["gap"])).alias("start"), (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["m"])).alias("end"), x["m"].alias("original")))).alias("out"),
    )
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(_REDACTION).alias("out")), put, lambda acc: acc["out"])


def redactions(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each redaction: df's other columns, step, category, start, end, original, replacement.

    start and end count characters of the text as the step found it, which is as the steps before left it. place orders
    a step's redactions from the last one back, the order in which replacing them moves none of the others. before: the
    text as the step found it.
    """
    keep = [c for c in df.columns if c != text]

    def described(i: int, category: str, to: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(i).alias("step"), F.lit(category).alias("category"), x["start"].alias("start"), x["end"].alias("end"), x["original"].alias("original"), F.lit(to).alias("replacement"))

    none = F.array().cast("array<struct<step: int, category: string, start: int, end: int, original: string, replacement: string>>")
    for i, (category, pattern, to) in enumerate(STEPS):
        own = F.lit(f"(?U){pattern}")
        matches = F.when(_may_match(i, F.col(text)), F.regexp_count(text, own)).otherwise(F.lit(0))
        df = df.withColumn(f"_n{i}", matches)
        df = df.withColumn(f"_f{i}", F.when(F.col(f"_n{i}") > 0, F.reverse(F.transform(_placed(text, own), described(i, category, to)))).otherwise(none))
        df = df.withColumn(f"_t{i}", F.when(F.col(f"_n{i}") > 0, F.col(text)))
        df = df.withColumn(text, F.when(F.col(f"_n{i}") > 0, F.regexp_replace(text, own, F.lit(to))).otherwise(F.col(text)))
    steps = F.array(*(F.struct(F.col(f"_f{i}").alias("found"), F.col(f"_t{i}").alias("before")) for i in range(len(STEPS))))
    each = df.select(*keep, F.explode(F.filter(steps, lambda s: F.size(s["found"]) > 0)).alias("s")).select(*keep, "s.before", F.posexplode("s.found").alias("place", "r"))
    return each.select(*keep, "r.*", "place", "before")
