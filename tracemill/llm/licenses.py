"""License scans by diagonal voting over rolling word k-grams, with DataFrame functions only.

All word k-grams of a text meet the k-grams of license templates in a broadcast join (the templates are a fixed list): by
the hash of the first two words, then by that of the whole gram, which is two words long for phrases and notices of a
line, K for whole license texts. A hit votes for the diagonal position - template position. Votes are summed by
diagonal, neighbouring diagonals are merged (a word more or less in the text moves the rest of a template to another
diagonal), and a merged run of votes is a span if it covers enough of the template within about its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .license_texts import BASE, NOTICES, TEXTS

#: Runs of ASCII letters and digits and of all characters beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram of whole texts.
K = 4
#: Diagonals up to so far apart are neighbours, or up to one in APART grams of a template; length of a span against its template.
SLACK, APART, STRETCH = 2, 20, 1.5
#: Share of the grams that a span must hold, of a notice and of a whole text, of which each changed word costs up to K.
COVER, COVER_TEXT = 0.85, 0.5
_MARK = ("\x01", "\x02")


@dataclass(frozen=True)
class Template:
    text: str
    label: str
    base: bool = False  # counted exactly
    k: int = 2
    cover: float = COVER

    def words(self) -> list[str]:
        return re.findall(LICENSE_WORD, self.text.lower())


def standard(k: int = K) -> list[Template]:
    """The phrases, notices and texts of license_texts, the last by grams of k words."""
    return [*(Template(t, x, base=True) for t, x in BASE), *(Template(t, x) for t, x in NOTICES), *(Template(t, x, k=k, cover=COVER_TEXT) for t, x in TEXTS)]


def _rows(templates: list[Template]) -> list[tuple]:
    """(words of the gram, template, label, base, at, grams, k, slack, cover) of all grams, and a mark that every text holds once."""
    rows = [(list(_MARK), -1, "", False, 0, 1, 2, 0, 1.0)]
    for i, t in enumerate(templates):
        w = t.words()
        n = len(w) - t.k + 1
        if n < 1 or t.k < 2:
            raise ValueError(f"a template has at least its k words, and k is at least 2: {t.text[:40]}")
        slack = 0 if t.base else max(SLACK, n // APART)
        rows += [(w[j : j + t.k], i, t.label, t.base, j, n, t.k, slack, t.cover) for j in range(n)]
    return rows


_GRAM = "words array<string>, template int, label string, base boolean, at int, grams int, k int, slack int, cover double"


def gram_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """The grams of templates with first, the hash of the hashes of their first two words, and gram, that of all of them."""
    rows = spark.createDataFrame(_rows(templates), _GRAM)
    most = max(2, *(t.k for t in templates))
    hashes = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    h = [F.get("h", F.lit(i)) for i in range(most)]  # null beyond the gram's words, which xxhash64 leaves out
    return hashes.withColumn("first", F.xxhash64(*h[:2])).withColumn("gram", F.xxhash64(*h)).drop("h", "words")


def spans(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (row, doc_id, n_words, template, label, base, votes, low, high, cover, good): a row for each merged run of votes, and one without template (-1) for each text.

    low and high are the first words of the run's first and last gram, cover its share of the template's grams; good
    marks the spans. row tells rows of docs apart by their place in the table.
    """
    templates = standard() if templates is None else templates
    sizes = sorted({t.k for t in templates} | {2})
    grams = F.broadcast(gram_table(docs.sparkSession, templates))  # a row per word of the templates
    # A-Z as a-z; what else lower() changes are letters beyond ASCII, or become k, which no base phrase holds
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(LICENSE_WORD), F.lit(0))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    marked = texts.select("row", "doc_id", F.size("words").alias("n_words"), F.transform(F.concat("words", F.array(*map(F.lit, _MARK))), lambda w: F.xxhash64(w)).alias("h"))
    zipped = F.arrays_zip(*(F.slice("h", i + 1, F.size("h")).alias(f"h{i}") if i else F.col("h").alias("h0") for i in range(sizes[-1])))
    rolled = marked.select("row", "doc_id", "n_words", F.posexplode(zipped).alias("pos", "g"))
    h = [F.col(f"g.h{i}") for i in range(sizes[-1])]
    rolled = rolled.select("row", "doc_id", "n_words", "pos", F.xxhash64(*h[:2]).alias("first"), *(F.xxhash64(*h[:k]).alias(f"gram{k}") for k in sizes[1:]))
    whole = F.col("k") == 2
    for k in sizes[1:]:
        whole = whole | ((F.col("k") == k) & (F.col(f"gram{k}") == F.col("gram")))
    of_row, of_template = ["row", "doc_id", "n_words"], ["template", "label", "base", "grams", "slack", "cover"]
    hits = rolled.join(grams, "first").where(whole).select(*of_row, *of_template, (F.col("pos") - F.col("at")).alias("diagonal"), "pos")

    votes = hits.repartition("row").groupBy(*of_row, *of_template, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    in_order = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > F.col("slack"), F.lit(True))
    merged = votes.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(in_order))
    runs = merged.groupBy(*of_row, *of_template, "run").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    good = F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise((share >= F.col("cover")) & (F.col("high") - F.col("low") + 1 <= STRETCH * F.col("grams")))
    return runs.select(*of_row, "template", "label", "base", "votes", "low", "high", share.alias("cover"), (good & (F.col("template") >= 0)).alias("good"))


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row for each row of docs.

    n_base counts the places of base templates, first_word and last_word are their smallest and largest start (null
    without any). labels holds those of all spans, score the largest share of a template's grams held by one, 0 without
    one, spans those of other than base templates, as label:low-high, in order. Null and empty texts have no words and no
    labels. Rows are told apart by their place in the table, not by doc_id, so repeated or missing ids are harmless. An
    empty table gives no rows.
    """
    is_base = F.col("good") & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")  # noqa: E731  no more values than there are labels
    place = F.struct("low", "high", "label")
    listed = F.array_sort(F.collect_set(F.when(F.col("good") & ~F.col("base"), place)))  # the spans of one text
    return spans(docs, templates).groupBy("row", "doc_id", "n_words").agg(
        F.sum(is_base.cast("long")).alias("n_base"),
        F.min(F.when(is_base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("low"))).cast("long").alias("last_word"),
        joined(is_base).alias("base_labels"),
        joined(F.col("good")).alias("labels"),
        F.max(F.when(F.col("good"), F.col("cover")).otherwise(0.0)).alias("score"),
        F.array_join(F.transform(listed, lambda x: F.format_string("%s:%d-%d", x["label"], x["low"], x["high"])), ",").alias("spans"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def _sql_grams() -> str:
    rows = []
    for words, template, label, base, at, grams, k, slack, cover in _rows(standard())[1:]:
        quoted = ", ".join(f"'{w}'" for w in words) + ", null::varchar" * (K - len(words))
        rows.append(f"({quoted}, {template}, '{label}', {str(base).lower()}, {at}, {grams}, {k}, {slack}, {cover})")
    return ", ".join(rows)


ORACLE = f"""
with grams({', '.join(f't{i}' for i in range(K))}, template, label, base, tpos, grams, k, slack, least) as (values {_sql_grams()}),
texts as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
rolled as (
  select doc_id, i, {', '.join(f'w[i + {j + 1}] as w{j}' for j in range(K))} from (select doc_id, w, unnest(range(0, len(w) - 1)) as i from texts where len(w) > 1)),
votes as (
  select doc_id, template, label, base, grams, slack, least, i - tpos as diagonal, count(*) as votes, min(i) as low, max(i) as high
  from rolled join grams on w0 = t0 and w1 = t1 where k = 2 or ({' and '.join(f'w{j} = t{j}' for j in range(2, K))}) group by all),
marked as (
  select *, case when coalesce(diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > slack, true) then 1 else 0 end as apart from votes),
merged as (
  select *, sum(apart) over (partition by doc_id, template order by diagonal) as run from marked),
runs as (
  select doc_id, template, label, base, grams, least, sum(votes) as votes, min(low) as low, max(high) as high from merged group by doc_id, template, label, base, grams, least, run),
good as (
  select *, least(1.0::double, votes::double / grams) as cover from runs
  where case when base then votes = grams else least(1.0::double, votes::double / grams) >= least and high - low + 1 <= {STRETCH} * grams end),
found as (
  select doc_id, count(*) filter (base) as n_base, min(low) filter (base) as first_word, max(low) filter (base) as last_word,
         array_to_string(list_sort(list_distinct(coalesce(list(label) filter (base), []))), ',') as base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') as labels, max(cover) as score
  from good group by doc_id),
listed as (
  select doc_id, string_agg(label || ':' || low || '-' || high, ',' order by low, high, label) as spans from (select distinct doc_id, label, low, high from good where not base) group by doc_id)
select t.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score, coalesce(spans, '') as spans
from texts t left join found using (doc_id) left join listed using (doc_id)
"""
