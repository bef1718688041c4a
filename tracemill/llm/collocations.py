"""Collocations: phrases of a few words that stand together more often than their parts would by chance.

1. A sketch over all words and pairs of the corpus: counts by hash cell, summed by Spark. A cell's count is an upper bound
   for each phrase in it, and a phrase is no more frequent than its words and pairs.
2. The same for longer phrases whose pairs all may be frequent.
3. Each shard of text compiles those of its own phrases that may be frequent by both into automata, whose patterns begin
   and end with the guard between words, and counts all matches, overlapping ones too. Counts are summed over the shards.
4. Thresholds, cuts and containment are joins over the phrases that are frequent indeed.

Automata hold a shard's phrases alone, no more than PATTERNS at once, so neither they nor what is broadcast grow with the
corpus: of each sketch one bit a cell is broadcast. Where the cells fill, less is pruned and the counts stay exact.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import HashFilter, Scratch

BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
LONGEST, MIN_COUNT, TOP, CONTAINED = 5, 100, 2000, 100
#: Cells of a sketch, and hashes that a task gathers before it counts them by cell.
CELLS, GATHER = 1 << 27, 1 << 21
#: Phrases in one automaton.
PATTERNS = 50_000
#: Texts of a language are handled in parts of about so many bytes; a longer one is cut at its breaks.
PART_BYTES = 4 << 20
#: Parts of several languages that a task gathers at most.
HELD = 3
#: Counted phrases that a task gathers before it adds up equal ones.
COUNTED = 1 << 20

_U = np.uint64
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[list(SPACES)] = True
#: What a guarded text is made of: lower case, one blank between words, and a line end between pieces.
_GUARDED = bytes(ord("\n") if _BREAK[b] else ord(" ") if _SEPARATOR[b] else b for b in ta.lowered(np.arange(256, dtype=np.uint8)).tolist())


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) of about PART_BYTES each; a long text in parts that end at breaks. No more than a few of them are held at once."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter[str] = Counter()

    def flush(lang: str) -> tuple[str, pa.Array]:
        sizes.pop(lang)
        return lang, pa.array(held.pop(lang), pa.large_binary()).view(pa.large_string())

    for batch in batches:
        for lang, text in zip(ta.column(batch, "lang").to_pylist(), ta.column(batch, "text"), strict=True):
            if text.is_valid:
                for piece in _parts(text.as_buffer().to_pybytes()):
                    held.setdefault(lang, []).append(piece)
                    sizes[lang] += len(piece)
                    if sizes[lang] >= PART_BYTES:
                        yield flush(lang)
        while sizes.total() > HELD * PART_BYTES:
            yield flush(sizes.most_common(1)[0][0])
    while held:
        yield flush(next(iter(held)))


def _parts(b: bytes) -> Iterator[bytes]:
    while len(b) > PART_BYTES:
        m = re.compile(b"[" + re.escape(BREAKS) + b"]").search(b, PART_BYTES)
        if m is None:
            break
        yield b[: m.end()]
        b = b[m.end() :]
    yield b


class Phrases:
    """Words of a shard, and the hashes of its phrases."""

    def __init__(self, lang: str, texts: pa.Array):
        self.lang, self.texts = lang, texts
        self.words = w = ta.words(texts, lower=True, separator=_SEPARATOR)
        piece = np.concatenate([[0], np.cumsum(_BREAK[w.data])])[w.start] + w.row
        #: Whether a word is followed by one of the same piece.
        self.next = np.zeros(len(piece), dtype=bool)
        self.next[:-1] = piece[1:] == piece[:-1]
        self.seed = _U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))

    def hash(self, at: np.ndarray, n: int) -> np.ndarray:
        return ta.mix(ta.gram_hash(self.words.hash, at, n) ^ self.seed)

    def longer(self, alive: np.ndarray) -> np.ndarray:
        """Starts of phrases one word longer of which both parts one word shorter are alive."""
        out = np.zeros(len(alive), dtype=bool)
        out[:-1] = alive[:-1] & alive[1:] & self.next[:-1]
        return out

    def may_be_frequent(self, longest: int, short: HashFilter, long: HashFilter | None) -> Iterator[tuple[int, np.ndarray]]:
        """(n, starts of phrases of n words that may be frequent): by their own cells, and where there is no sketch of theirs yet by those of their parts."""
        alive = np.ones(len(self.words.hash), dtype=bool)
        for n in range(1, longest + 1):
            alive = self.longer(alive) if n > 1 else alive
            sketch = short if n <= 2 else long
            if sketch is not None:
                at = np.flatnonzero(alive)
                alive = np.zeros(len(alive), dtype=bool)
                alive[at[sketch(self.hash(at, n))]] = True
            yield n, np.flatnonzero(alive)


def _cells(hashes: Iterator[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """Counts by cell, of many hashes at once."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(cells), pa.array(counts.astype(np.int32))], names=["cell", "n"])

    for h in hashes:
        held.append((h & _U(width - 1)).astype(np.int32))
        size += len(h)
        if size >= GATHER:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _short(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    def hashes() -> Iterator[np.ndarray]:
        for p in (Phrases(*x) for x in shards(batches)):
            yield p.hash(np.arange(len(p.words.hash)), 1)
            yield p.hash(np.flatnonzero(p.next), 2)

    return _cells(hashes(), width)


def _long(batches: Iterator[pa.RecordBatch], width: int, longest: int, short: HashFilter) -> Iterator[pa.RecordBatch]:
    return _cells((p.hash(at, n) for p in (Phrases(*x) for x in shards(batches)) for n, at in p.may_be_frequent(longest, short, None) if n > 2), width)


def _count(batches: Iterator[pa.RecordBatch], longest: int, short: HashFilter, long: HashFilter) -> Iterator[pa.Table]:
    """How often each phrase stands in a shard, and under a null phrase its words."""
    for lang, texts in shards(batches):
        p = Phrases(lang, texts)
        w = p.words
        phrases: list[str | None] = [None]
        counts = [np.array([len(w.hash)])]
        patterns: list[str] = []
        for n, at in p.may_be_frequent(longest, short, long):
            at = at[np.unique(p.hash(at, n), return_index=True)[1]]
            patterns += [(b" %b " % b" ".join(w.texts(k, k + n))).decode() for k in at.tolist()]
        guarded = b" \n ".join(x.as_buffer().to_pybytes() for x in texts).translate(_GUARDED).replace(b"\n", b" \n ")
        guarded = re.sub(rb" {2,}", b" ", b" %b " % guarded).decode()
        for i in range(0, len(patterns), PATTERNS):
            automaton, some = ahocorasick.Automaton(), patterns[i : i + PATTERNS]
            for k, pattern in enumerate(some):
                automaton.add_word(pattern, k)
            automaton.make_automaton()
            counts.append(np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(guarded)), np.int32), minlength=len(some)))
            phrases += [x[1:-1] for x in some]
        yield pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()), "n": pa.array(np.concatenate(counts), pa.int64())})


def _added(tables: Iterator[pa.Table]) -> pa.Table | None:
    """Sums by lang and phrase."""
    held: list[pa.Table] = []
    for table in tables:
        held.append(table)
        if sum(t.num_rows for t in held) >= COUNTED and len(held) > 1:
            held = [_sum(held)]
    return _sum(held) if held else None


def _sum(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
    return pa.table({"lang": out["lang"], "phrase": out["phrase"], "n": out["n_sum"]})


_COUNTS = pa.struct([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _packed(tables: Iterator[pa.Table], buckets: int) -> Iterator[pa.RecordBatch]:
    """All sums of a task, a row for each bucket of phrases' hashes."""
    total = _added(tables)
    if total is None:
        return
    data, at = ta.raw(total["phrase"])
    bucket = (ta.hashes(data, at[:-1], at[1:]) % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    total, bucket = total.take(pa.array(order)).combine_chunks(), bucket[order]
    edges = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]])
    rows = pa.StructArray.from_arrays([total[c].combine_chunks() if total[c].num_chunks else pa.array([], _COUNTS.field(c).type) for c in ("lang", "phrase", "n")], fields=list(_COUNTS))
    for i in range(0, len(edges) - 1, 64):
        some = edges[i : i + 65]
        counts = pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), rows.slice(some[0], some[-1] - some[0]))
        yield pa.record_batch([pa.array(bucket[some[:-1]]), counts], names=["bucket", "counts"])


def _unpacked(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """Sums over all tasks, of phrases that are frequent and of words."""
    total = _added(pa.Table.from_struct_array(batch.column(1).flatten()) for batch in batches if batch.num_rows)
    if total is not None:
        keep = pc.or_(pc.is_null(total["phrase"]), pc.greater_equal(total["n"], min_count))
        yield from total.filter(keep).to_batches(max_chunksize=10_000)


def frequent_phrases(docs: DataFrame, scratch: Scratch, longest: int = LONGEST, min_count: int = MIN_COUNT, cells: int = CELLS) -> DataFrame:
    """docs(lang, text) -> (lang, phrase, n): all phrases of 1 to `longest` words that stand min_count times or more, and under a null phrase the number of words."""

    def sketch(task, name: str) -> HashFilter:
        counts = docs.mapInArrow(task, "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        return HashFilter(scratch.save(counts.select(F.col("cell").cast("long").alias("cell")), name), "cell", cells)

    short = sketch(lambda it: _short(it, cells), "short")
    long = sketch(lambda it: _long(it, cells, longest, short), "long")
    # a row for each task and bucket: each task has nearly all frequent phrases, so they are added up where they are counted
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.mapInArrow(lambda it: _packed(_count(it, longest, short, long), buckets), "bucket int, counts array<struct<lang: string, phrase: string, n: long>>")
    return scratch.save(packed.repartition("bucket").mapInArrow(lambda it: _unpacked(it, min_count), "lang string, phrase string, n long"), "phrases")


#: floor(1000 a n / (l r)); the products may pass 64 bits.
SCORE = "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP, contained: int = CONTAINED, cells: int = CELLS) -> DataFrame:
    """docs(text, lang, ...) -> (lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language.

    Texts, A-Z in lower case, fall into pieces at . , ; : ! ? and line ends, and these into words at blanks and tabs. Per
    language, n counts all words and f the contiguous occurrences of a phrase within pieces. Candidates have 2 to `longest`
    words and a = f(phrase) >= min_count. Cutting one after k words gives l = f(first part), r = f(rest) and the score
    floor(1000 a n / (l r)); the lowest-scoring cut counts, of equal ones the first. Candidates that lie inside a longer
    one with 100 f(longer) >= contained * a go. Rank is by score and a, both descending, then by phrase in order of bytes.

    Null texts are empty and null languages are `und`. Ids play no part: each row counts, repeated ones too. Texts
    without words, and an empty table, give no rows. Scores are exact while counts stay under 10^17. cells: size of a
    sketch, a power of two; it changes no result.
    """
    if longest < 2:
        raise ValueError("phrases have at least two words")
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counts = frequent_phrases(docs, scratch, longest, min_count, cells)
    known = counts.where("phrase is not null").withColumnRenamed("n", "f")
    totals = counts.where("phrase is null").select("lang", "n")
    candidates = known.withColumn("words", F.split("phrase", " ")).where("size(words) >= 2").withColumnRenamed("f", "a")
    cuts = candidates.join(totals, "lang").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("array_join(slice(words, 1, k), ' ')")).withColumn("rest", F.expr("array_join(slice(words, k + 1, size(words)), ' ')")).drop("words")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    lowest = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    # a phrase inside a longer one also lies inside one that is longer by a word and at least as frequent as that
    parts = candidates.where("size(words) >= 3").withColumn("phrase", F.explode(F.expr("transform(array(1, 2), i -> array_join(slice(words, i, size(words) - 1), ' '))")))
    around = parts.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = lowest.select("lang", "phrase", "cut.*").join(around, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < contained * F.col("a")))
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language's phrases are ranked in parts first, so that no task sorts all of them
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
f as (
  select lang, phrase, size, count(*) as f from (
    select lang, size, array_to_string(w[i : i + size - 1], ' ') as phrase from (
      select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from words cross join (select unnest(range(1, {LONGEST + 1})) as size) where len(w) >= size))
  group by lang, phrase, size having count(*) >= {MIN_COUNT}),
c as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w from f where size >= 2),
cuts as (
  select c.lang, c.phrase, a, n, k, x.f as l, y.f as r, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score
  from (select *, unnest(range(1, size)) as k from c) c join totals using (lang)
  join f x on x.lang = c.lang and x.phrase = array_to_string(w[1 : k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1 :], ' ')),
low as (select *, row_number() over (partition by lang, phrase order by score, k) as place from cuts),
inside as (
  select distinct s.lang, s.phrase from c s join (
    select lang, a, array_to_string(w[i : i + m - 1], ' ') as phrase
    from (select *, unnest(range(1, size - m + 2)) as i from (select *, unnest(range(2, size)) as m from c))) b
  on b.lang = s.lang and b.phrase = s.phrase where 100 * b.a >= {CONTAINED} * s.a)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank
  from low anti join inside using (lang, phrase) where place = 1) where rank <= {TOP}
"""
