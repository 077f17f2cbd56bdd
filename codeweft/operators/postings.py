"""Full-text search over a written posting index.

An index has three tables, each partitioned by token set and lexeme bucket or by set alone, and written when it is
first asked for:

- postings: (set, bucket, lexeme, doc, weight, head, positions), in runs sorted by lexeme; `head` marks one row a
  lexeme and document. A bucket is a hash
  of a lexeme's first two characters, so an exact term and a prefix of two characters or more name one
  bucket, whose files are read whole. Each task writes the postings of its documents to
  files of its own, one a bucket, so nothing is shuffled and a lexeme of every document is many files. On disk the postings of a
  lexeme in neighbouring documents (some MB of text) are one row of arrays.
- terms: (set, bucket, lexeme, docs, occurrences), the statistics a search is ordered by.
- texts: (set, doc, n, starts, lengths), the tokens' character ranges in order of position.

Set `normal` holds all tokens, `no_symbols` those that are not symbols. Stop words are left out and leave
no gap: positions count the tokens kept, from 0. Every token has a weight, A to D.

Queries are trees of Term, Not, And, Or and Phrase. A search reads the buckets of its terms once, whatever
the tree, gathers one sorted array of positions for each term and document, and evaluates the tree on
these arrays. Terms that every match must have are known from the tree; if the rarest of them is in far
fewer documents than the others, the others' postings are first reduced to its documents. Within a phrase
the arrays are intersected from the rarest on. A negated term inside a phrase stands for some other token
at that place. Documents without any of the terms are looked at only where the tree can match them.

Null texts have no tokens. A null document key is a document of its own only if its rows are one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.porter import STOP, tokenize
from codeweft.plans.register import query
from codeweft.sources.tables import ROWS, once, pieces, spread, table, unfolded

BUCKETS = 32
#: Bytes of input whose postings become one file a set and bucket; larger splits are not cut.
SEGMENT = 16 << 20
#: Texts of so many times `PIECE` bytes share the rows of their lexemes.
GATHERED = 8
SETS = ("normal", "no_symbols")
#: The rarest term filters the others if they are in this many times its documents.
SELECTIVE = 4

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

Token = tuple[str, int, int, bool, str]


def blanks(text: str) -> Iterable[Token]:
    """What stands between single blanks, lower-cased; nothing is a stop word or a symbol."""
    at = 0
    for piece in text.split(" "):
        yield piece.lower(), at, len(piece), False, "D"
        at += len(piece) + 1


WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SYMBOL = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
_TOKEN = re.compile(f"{WORD}|{SYMBOL}")
_SYMBOLS = frozenset(filter(re.compile(SYMBOL).match, map(chr, range(128))))


def prose(text: str) -> Iterable[Token]:
    """Words (A-Z lower-cased) without stop words, and single symbols; what stands in the first line weighs A."""
    head = text.find("\n") if "\n" in text else len(text)
    for m in _TOKEN.finditer(text.encode().lower().decode()):  # of bytes, lower() changes A-Z alone
        word = m[0]
        if word not in STOP:
            start, stop = m.span()
            yield word, start, stop - start, word in _SYMBOLS, "A" if start < head else "D"


def source(text: str) -> Iterable[Token]:
    """Tokens of source files; comments, names and strings are split and stemmed as prose."""
    return (t + ("D",) for t in tokenize(text))


ANALYSERS: dict[str, tuple[Callable[[str], Iterable[Token]], tuple[str, ...]]] = {"blanks": (blanks, SETS[:1]), "prose": (prose, SETS), "source": (source, SETS)}


def bucket_of(text: str) -> int:
    return zlib.crc32(text[:2].encode()) % BUCKETS


def _tokens(bodies: list, cut: Callable[[str], Iterable[Token]], ranged: bool = True) -> tuple[list[tuple[str, str]], list[np.ndarray], np.ndarray]:
    """Of all texts: the lexemes with their weights, in order; of each token which of them it is, start, length (if `ranged`) and whether it is a symbol; the ends of the texts."""
    index: dict[tuple[str, str], int] = {}
    columns, ends = [array("i"), array("i"), array("i"), array("b")], [0]
    codes, at, size, symbols = columns
    for body in bodies:
        for word, start, length, symbol, weight in cut(body) if body is not None else ():
            key = word, weight
            code = index.get(key)
            if code is None:
                code = index[key] = len(index)
            codes.append(code)
            symbols.append(symbol)
            if ranged:
                at.append(start)
                size.append(length)
        ends.append(len(codes))
    words, ranks = sorted(index), np.zeros(len(index), np.int32)
    ranks[[index[w] for w in words]] = np.arange(len(words))
    return words, [ranks[np.frombuffer(codes, np.int32)], *(np.frombuffer(c, c.typecode) for c in columns[1:])], np.array(ends)


def _lists(ends: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def _bodies(frame: DataFrame, key: str, text: str) -> DataFrame:
    return spread(frame.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("body")))


def analysed(frame: DataFrame, key: str, text: str, analyser: str) -> DataFrame:
    """(set, doc, n, starts, lengths): the character ranges of each document's tokens."""
    cut, sets = ANALYSERS[analyser]

    def run(batches):
        for piece in pieces(batches, "body"):
            _, (_, at, size, symbols), ends = _tokens(piece.column("body").to_pylist(), cut)
            for name in sets:
                kept = np.ones(len(at), bool) if name == "normal" else symbols == 0
                own = np.concatenate([[0], np.cumsum(kept)])[ends]
                columns = [pa.array([name] * piece.num_rows, pa.string()), piece.column("doc"), pa.array(np.diff(own), pa.int32()), _lists(own, at[kept]), _lists(own, size[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=["set", "doc", "n", "starts", "lengths"])

    return _bodies(frame, key, text).mapInArrow(run, f"set string, doc {frame.schema[key].dataType.simpleString()}, n int, starts array<int>, lengths array<int>")


def _entries(name: str, docs: pa.Array, words: list[tuple[str, str]], codes: np.ndarray, own: np.ndarray) -> Iterable[pa.RecordBatch]:
    """A row a lexeme and weight, in order, from each token's code in order of document and position; `own` has the documents' ends."""
    who = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(own))
    numbers: dict[str, int] = {}
    lexeme = np.array([numbers.setdefault(word, len(numbers)) for word, _ in words], np.int64)
    head = (np.bincount(lexeme, minlength=1) == 1)[lexeme[codes]] if words else np.zeros(0, bool)
    others = np.flatnonzero(~head)  # of lexemes with several weights, a document's first token marks the row
    head[others[np.unique(lexeme[codes[others]] * len(docs) + who[others], return_index=True)[1]]] = True
    order = np.argsort(codes, kind="stable")  # by lexeme, in order of document and position
    turn = np.diff(codes[order], prepend=-1) != 0
    first = np.flatnonzero(turn | (np.diff(who[order], prepend=-1) != 0))
    rows, at = np.flatnonzero(turn[first]), order[first]
    held, ends, stops = codes[at[rows]], np.append(rows, len(first)), np.append(first, len(codes))
    for i in range(0, len(rows), ROWS):
        mine, end = [words[c] for c in held[i : i + ROWS].tolist()], ends[i : i + ROWS + 1]
        entry, token = at[end[0] : end[-1]], order[stops[end[0]] : stops[end[-1]]]
        places = _lists(stops[end[0] : end[-1] + 1] - stops[end[0]], token - own[who[token]])
        columns = [pa.array([name] * len(mine), pa.string()), pa.array([w for w, _ in mine], pa.string()), pa.array([w for _, w in mine], pa.string())]
        lists = [_lists(end - end[0], x) for x in (docs.take(pa.array(who[entry])), pa.array(head[entry]), places)]
        yield pa.RecordBatch.from_arrays([*columns, *lists], names=["set", "lexeme", "weight", "doc", "head", "positions"])


def posted(frame: DataFrame, key: str, text: str, analyser: str) -> DataFrame:
    """(set, lexeme, weight, doc, head, positions): some neighbouring documents' postings of a lexeme in a row, the last three as arrays."""
    cut, sets = ANALYSERS[analyser]

    def run(batches):
        for piece in pieces(batches, "body", share=GATHERED):
            words, (codes, _, _, symbols), ends = _tokens(piece.column("body").to_pylist(), cut, ranged=False)
            for name in sets:
                kept = np.ones(len(codes), bool) if name == "normal" else symbols == 0
                yield from _entries(name, piece.column("doc"), words, codes[kept], np.concatenate([[0], np.cumsum(kept)])[ends])

    rows = _bodies(frame, key, text)
    size, splits = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), rows.rdd.getNumPartitions()
    rows = rows.coalesce(min(splits, max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // SEGMENT))))
    return rows.mapInArrow(run, f"set string, lexeme string, weight string, doc array<{frame.schema[key].dataType.simpleString()}>, head array<boolean>, positions array<array<int>>")


class Index:
    """The three tables of the texts of a frame below `path`. Each is written when it is first asked for, so a query leaves on disk what it reads."""

    def __init__(self, frame: DataFrame, key: str, text: str, path: str, analyser: str):
        self.frame, self.key, self.text, self.path, self.analyser = frame, key, text, path, analyser
        self.kind = frame.schema[key].dataType.simpleString()

    def _written(self, name: str, rows: DataFrame, schema: str, *by: str, ordered: str) -> DataFrame:
        """`ordered`: a column whose neighbouring values are alike, so what is stored is how they differ."""
        path = f"{self.path}/{name}"
        stored = {"compression": "zstd", "parquet.writer.version": "v2", f"parquet.enable.dictionary#{ordered}": "false"}
        spark = self.frame.sparkSession
        before = spark.conf.get(WRITERS)
        spark.conf.set(WRITERS, len(SETS) * BUCKETS + 1)  # with as many writers as folders or fewer, Spark sorts the rows, which spills several times the input
        try:
            rows.write.mode("overwrite").options(**stored).partitionBy(*by).parquet(path)  # what is there is left of an attempt that failed
        finally:
            spark.conf.set(WRITERS, before)
        return spark.read.schema(schema).parquet(path)

    @cached_property
    def lists(self) -> DataFrame:
        """Postings as they are written, neither shuffled nor sorted by Spark: they leave Python in order of lexeme."""
        rows = posted(self.frame, self.key, self.text, self.analyser)
        rows = rows.withColumn("bucket", F.pmod(F.crc32(F.substring("lexeme", 1, 2)), F.lit(BUCKETS)).cast("int"))
        return self._written("postings", rows, f"lexeme string, weight string, doc array<{self.kind}>, head array<boolean>, positions array<array<int>>, set string, bucket int", "set", "bucket", ordered="lexeme")

    @property
    def postings(self) -> DataFrame:
        """Postings, a row a lexeme, weight and document."""
        return self.lists.select("set", "bucket", "lexeme", "weight", F.inline(F.arrays_zip("doc", "head", "positions")))

    @cached_property
    def terms(self) -> DataFrame:
        docs, places = F.size(F.filter("head", lambda h: h)), F.size(F.flatten("positions"))
        counted = self.lists.groupBy("set", "bucket", "lexeme").agg(F.sum(docs).alias("docs"), F.sum(places).alias("occurrences"))
        rows = counted.repartition("set", "bucket").sortWithinPartitions("set", "bucket", "lexeme")
        return self._written("terms", rows, "lexeme string, docs long, occurrences long, set string, bucket int", "set", "bucket", ordered="lexeme")

    @cached_property
    def texts(self) -> DataFrame:
        rows = analysed(self.frame, self.key, self.text, self.analyser)
        return self._written("texts", rows, f"doc {self.kind}, n int, starts array<int>, lengths array<int>, set string", "set", ordered="starts.list.element")


def build(frame: DataFrame, key: str, text: str, path: str, analyser: str = "prose") -> Index:
    """The index of all texts, to be written below `path`."""
    return Index(frame, key, text, path, analyser)


def index_of(spark: SparkSession, root: str, name: str = "documents", key: str = "doc_id", text: str = "text", analyser: str = "prose") -> Index:
    """The index of a table, built when it is first asked for and kept for later queries of this session."""
    return once(spark, (root, name, key, text, analyser), lambda path: build(table(spark, root, name), key, text, path, analyser))


@dataclass(frozen=True)
class Term:
    """A lexeme, or all that start with it; with weights, only its occurrences of these."""

    text: str
    prefix: bool = False
    weights: str = ""


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Phrase:
    """Terms, or negated terms, each `distance` after the one before."""

    parts: tuple
    distance: int = 1


def flat(phrase: Phrase, at: int = 0) -> list[tuple[object, int]]:
    """The terms of nested phrases with their places."""
    out, place = [], at
    for i, part in enumerate(phrase.parts):
        place += phrase.distance if i else 0
        if isinstance(part, Phrase):
            inner = flat(part, place)
            out += inner
            place = inner[-1][1] if inner else place
        elif isinstance(part, Term) or isinstance(part, Not) and isinstance(part.of, Term):
            out.append((part, place))
        else:
            raise ValueError("a phrase has terms, negated terms and phrases")
    return out


def leaves(tree: object) -> list[Term]:
    """The distinct terms of a tree."""
    if isinstance(tree, Term):
        return [tree]
    inner = [tree.of] if isinstance(tree, Not) else [p for p, _ in flat(tree)] if isinstance(tree, Phrase) else tree.parts
    return list(dict.fromkeys(t for p in inner for t in leaves(p)))


def required(tree: object) -> set[Term]:
    """Terms that every matching document has."""
    if isinstance(tree, Term):
        return {tree}
    if isinstance(tree, Phrase):
        return {p for p, _ in flat(tree) if isinstance(p, Term)}
    if isinstance(tree, And):
        return set().union(*map(required, tree.parts))
    if isinstance(tree, Or) and tree.parts:
        return set.intersection(*map(required, tree.parts))
    return set()


def without_terms(tree: object) -> bool:
    """Whether a document that has none of the terms may match."""
    if isinstance(tree, Not):
        return not without_terms(tree.of) or _lengths_matter(tree.of)
    if isinstance(tree, Phrase):
        return not required(tree)
    if isinstance(tree, And | Or):
        return (all if isinstance(tree, And) else any)(without_terms(p) for p in tree.parts)
    return False


def _lengths_matter(tree: object) -> bool:
    """Whether a phrase has a negated term: what stands for it depends on the document's length."""
    if isinstance(tree, Phrase):
        return any(isinstance(p, Not) for p, _ in flat(tree))
    return any(map(_lengths_matter, [tree.of] if isinstance(tree, Not) else getattr(tree, "parts", ())))


def _phrased(tree: object) -> bool:
    return isinstance(tree, Phrase) or any(map(_phrased, [tree.of] if isinstance(tree, Not) else getattr(tree, "parts", ())))


def holds(term: Term, lexeme: str | Column = "lexeme") -> Column:
    lexeme = F.col(lexeme) if isinstance(lexeme, str) else lexeme
    return lexeme.startswith(term.text) if term.prefix else lexeme == term.text


def reading(rows: DataFrame, terms: list[Term], which: str) -> DataFrame:
    """Rows of the terms: only their buckets' files are read, unless a prefix is too short to name one."""
    rows = rows.where(F.col("set") == which)
    if all(len(t.text) >= 2 or not t.prefix for t in terms):
        rows = rows.where(F.col("bucket").isin(sorted({bucket_of(t.text) for t in terms})))
    return rows.where(reduce(Column.__or__, map(holds, terms), F.lit(False)))


EMPTY = "array<int>"


def evaluated(tree: object, at: dict[Term, Column], seen: dict[Term, int], n: Column) -> tuple[Column, Column]:
    """Whether a document matches and the positions that contribute, from each term's sorted positions."""
    none = F.array().cast(EMPTY)
    if isinstance(tree, Term):
        return F.size(at[tree]) > 0, at[tree]
    if isinstance(tree, Not):
        return ~evaluated(tree.of, at, seen, n)[0], none
    if isinstance(tree, Phrase):
        places = flat(tree)
        if not places:
            return F.lit(True), none
        shifted = lambda term, place: F.transform(at[term], lambda x: x - place)
        plain = sorted(((p, d) for p, d in places if isinstance(p, Term)), key=lambda x: seen[x[0]])
        base = reduce(F.array_intersect, [shifted(*x) for x in plain]) if plain else F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
        inside = lambda place: lambda b: (b + place >= 0) & (b + place < n)
        for part, place in places:
            if isinstance(part, Not):
                base = F.array_except(F.filter(base, inside(place)), shifted(part.of, place))
        return F.size(base) > 0, F.flatten(F.transform(base, lambda b: F.array(*[b + d for _, d in places])))
    sides = [evaluated(part, at, seen, n) for part in tree.parts]
    union = lambda parts: reduce(F.array_union, parts, none)
    if isinstance(tree, Or):
        return reduce(Column.__or__, [m for m, _ in sides], F.lit(False)), union([F.when(m, p).otherwise(none) for m, p in sides])
    every = reduce(Column.__and__, [m for m, _ in sides], F.lit(True))
    return every, F.when(every, union([p for _, p in sides])).otherwise(none)


def search(index: Index, tree: object, which: str = "normal", scope: DataFrame | None = None) -> DataFrame:
    """(doc, positions): documents that match, of `scope` (doc) if given, with the sorted positions that contributed."""
    terms = leaves(tree)
    counted = (0,) * (2 * len(terms) + 1)
    if len(terms) > 1 and (required(tree) or _phrased(tree)):  # else nothing is ordered by them
        counted = reading(index.terms, terms, which).agg(*[F.coalesce(F.sum(F.when(holds(t), F.col(c))), F.lit(0)) for t in terms for c in ("docs", "occurrences")], F.lit(0)).first()
    docs, seen = dict(zip(terms, counted[::2], strict=False)), dict(zip(terms, counted[1::2], strict=False))
    rows = reading(index.postings, terms, which)
    if scope is not None:
        rows = rows.join(scope.select("doc"), "doc", "left_semi")
    must = min(required(tree), key=lambda t: docs[t], default=None)
    if must is not None and sum(docs.values()) - docs[must] > SELECTIVE * docs[must]:
        rows = rows.join(reading(index.postings, [must], which).select("doc"), "doc", "left_semi")
    mine = lambda t: holds(t) & F.col("weight").isin(list(t.weights)) if t.weights else holds(t)
    gathered = rows.groupBy("doc").agg(F.count("*").alias("rows"), *[F.array_sort(F.flatten(F.collect_list(F.when(mine(t), F.col("positions"))))).alias(f"p{i}") for i, t in enumerate(terms)])
    every = without_terms(tree)
    if every or _lengths_matter(tree):
        sizes = index.texts.where(F.col("set") == which).select("doc", "n")
        sizes = sizes if scope is None or not every else sizes.join(scope.select("doc"), "doc", "left_semi")
        gathered = sizes.join(gathered, "doc", "left" if every else "inner")
    else:
        gathered = gathered.withColumn("n", F.lit(0))
    at = {t: F.coalesce(F.col(f"p{i}"), F.array().cast(EMPTY)) for i, t in enumerate(terms)}
    match, positions = evaluated(tree, at, seen, F.col("n"))
    return gathered.where(match).select("doc", F.array_sort(F.array_distinct(positions)).alias("positions"))


def ranges(index: Index, found: DataFrame, which: str = "normal") -> DataFrame:
    """(doc, positions, ranges): with the character range (start, length) of each position."""
    texts = index.texts.where(F.col("set") == which).select("doc", "starts", "lengths")
    at = F.transform("positions", lambda p: F.struct(F.get("starts", p).alias("start"), F.get("lengths", p).alias("length")))
    return found.join(texts, "doc").select("doc", "positions", at.alias("ranges"))


REGION = "first_line int, last_line int, start int, stop int, hits int"


def merged_lines(text: str, hits: list[tuple[int, int]], context: int) -> list[tuple[int, int, int, int, int]]:
    """Half-open runs of lines within `context` lines of a hit: lines, characters, and the hits they hold."""
    edges = np.array([0, *(i + 1 for i, c in enumerate(text) if c == "\n"), len(text) + 1])
    out: list[list[int]] = []
    for start, length in hits:
        first = max(0, int(np.searchsorted(edges, start, side="right")) - 1 - context)
        last = min(len(edges) - 1, int(np.searchsorted(edges, max(start, start + length - 1), side="right")) + context)
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
            out[-1][2] += 1
        else:
            out.append([first, last, 1])
    return [(a, b, int(edges[a]), min(len(text), int(edges[b]) - 1), n) for a, b, n in out]


def regions(found: DataFrame, docs: DataFrame, key: str, text: str, context: int = 2) -> DataFrame:
    """(doc, first_line, last_line, start, stop, hits): what a result page shows of each document of `ranges`."""

    shown = lambda body, hits: merged_lines(body or "", [(h["start"], h["length"]) for h in hits], context)
    bodies = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("body"))
    return unfolded(found.join(bodies, "doc"), ["doc"], shown, REGION, ["body"], ["ranges"])


def _listed(found: DataFrame) -> DataFrame:
    return found.select("doc", F.size("positions").cast("long").alias("n"), F.array_min("positions").cast("long").alias("first"))


BLANKS = ", idx AS (SELECT doc_id AS doc, unnest(w) AS lexeme, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents))"


@query("fts05_inverted_index", f"{BLANKS} SELECT lexeme, count(DISTINCT doc) AS docs, count(*) AS occurrences FROM idx GROUP BY lexeme")
def fts05(spark, root):
    return index_of(spark, root, analyser="blanks").terms.select("lexeme", "docs", "occurrences")


@query("fts08_term_positions", f"{BLANKS} SELECT doc, count(*) AS n, min(pos) AS first FROM idx WHERE lexeme = 'of' GROUP BY doc")
def fts08(spark, root):
    return _listed(search(index_of(spark, root, analyser="blanks"), Term("of")))


OF_THE = f"{BLANKS}, hit AS (SELECT a.doc, a.pos FROM idx a JOIN idx b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.lexeme = 'of' AND b.lexeme = 'the'), every AS (SELECT doc, pos FROM hit UNION SELECT doc, pos + 1 FROM hit)"


@query("fts09_phrase", f"{OF_THE} SELECT doc, count(*) AS n, min(pos) AS first FROM every GROUP BY doc")
def fts09(spark, root):
    return _listed(search(index_of(spark, root, analyser="blanks"), Phrase((Term("of"), Term("the")))))


@query("fts09_phrase_with_negation", f"{BLANKS}, hit AS (SELECT a.doc, a.pos FROM idx a JOIN idx b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.lexeme = 'of' AND b.lexeme <> 'the'), every AS (SELECT doc, pos FROM hit UNION SELECT doc, pos + 1 FROM hit) SELECT doc, count(*) AS n, min(pos) AS first FROM every GROUP BY doc")
def fts09n(spark, root):
    return _listed(search(index_of(spark, root, analyser="blanks"), Phrase((Term("of"), Not(Term("the"))))))


@query("fts06_boolean_query", f"{BLANKS} SELECT DISTINCT doc FROM idx a WHERE (lexeme = 'the' OR starts_with(lexeme, 'que')) AND EXISTS (SELECT 1 FROM idx b WHERE b.doc = a.doc AND b.lexeme = 'of') AND NOT EXISTS (SELECT 1 FROM idx b WHERE b.doc = a.doc AND b.lexeme = 'was')")
def fts06(spark, root):
    tree = And((Or((Term("the"), Term("que", prefix=True))), Term("of"), Not(Term("was"))))
    return search(index_of(spark, root, analyser="blanks"), tree).select("doc")


@query("fts10_search_with_filter", f"{OF_THE} SELECT d.source, doc, count(*) AS n FROM every JOIN documents d ON d.doc_id = doc WHERE d.source IN ('src1', 'src2') GROUP BY ALL")
def fts10(spark, root):
    """Only the documents of two sources."""
    scope = table(spark, root, "documents").where(F.col("source").isin("src1", "src2")).select(F.col("doc_id").alias("doc"), "source")
    found = search(index_of(spark, root, analyser="blanks"), Phrase((Term("of"), Term("the"))), scope=scope)
    return found.join(scope, "doc").select("source", "doc", F.size("positions").cast("long").alias("n"))


_STOPS = ", ".join(f"'{w}'" for w in sorted(STOP))
PROSE = f"""
, raw AS (SELECT doc_id AS doc, text, coalesce(nullif(strpos(text, chr(10)) - 1, -1), length(text)) AS head, regexp_extract_all(text, '{WORD}|{SYMBOL}') AS hits, string_split_regex(text, '{WORD}|{SYMBOL}') AS gaps FROM documents),
cut AS (SELECT doc, head, hit, i, sum(length(gap) + length(hit)) OVER (PARTITION BY doc ORDER BY i) - length(hit) AS start
  FROM (SELECT doc, head, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM raw)),
kept AS (SELECT doc, i, start, length(hit) AS length, translate(hit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lexeme, regexp_full_match(hit, '{SYMBOL}') AS symbol, CASE WHEN start < head THEN 'A' ELSE 'D' END AS weight FROM cut),
idx AS (SELECT s AS set, doc, lexeme, weight, start, length, row_number() OVER (PARTITION BY s, doc ORDER BY i) - 1 AS pos
  FROM kept, (VALUES ('normal'), ('no_symbols')) v(s) WHERE lexeme NOT IN ({_STOPS}) AND (s = 'normal' OR NOT symbol))"""


@query("fts05_posting_lists", f"{PROSE} SELECT set, lexeme, weight, count(DISTINCT doc) AS docs, count(*) AS occurrences, CAST(sum(pos) AS BIGINT) AS places FROM idx GROUP BY set, lexeme, weight")
def fts05_lists(spark, root):
    """What the written postings hold: both sets, weights, positions without gaps for stop words."""
    rows = index_of(spark, root).lists.withColumn("positions", F.flatten("positions"))
    return rows.groupBy("set", "lexeme", "weight").agg(F.sum(F.size("doc")).alias("docs"), F.sum(F.size("positions")).alias("occurrences"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x)).alias("places"))


@query("fts05_token_ranges", f"{PROSE} SELECT set, doc, count(*) AS n, CAST(sum((pos + 1) * start) AS BIGINT) AS starts, CAST(sum((pos + 1) * length) AS BIGINT) AS lengths FROM idx GROUP BY set, doc")
def fts05_ranges(spark, root):
    """The stored character ranges of each document, weighed by position."""
    rows = index_of(spark, root).texts.where("n > 0")
    weighed = lambda c: F.aggregate(F.transform(c, lambda x, i: (i + 1).cast("long") * x), F.lit(0).cast("long"), lambda s, x: s + x).alias(c)
    return rows.select("set", "doc", F.col("n").cast("long").alias("n"), weighed("starts"), weighed("lengths"))


@query("fts08_weighted_terms", f"{PROSE} SELECT doc, count(*) AS n, min(pos) AS first FROM idx WHERE set = 'no_symbols' AND (lexeme = 'de' AND weight = 'A' OR starts_with(lexeme, 'ente') AND weight IN ('B', 'D')) GROUP BY doc")
def fts08_weighted(spark, root):
    tree = Or((Term("de", weights="A"), Term("ente", prefix=True, weights="BD")))
    return _listed(search(index_of(spark, root), tree, "no_symbols"))


_DE_LA = f"{PROSE}, hit AS (SELECT a.doc, a.pos, b.pos AS last FROM idx a JOIN idx b ON a.set = b.set AND a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.set = 'no_symbols' AND a.lexeme = 'de' AND b.lexeme = 'la'), spots AS (SELECT doc, pos FROM hit UNION SELECT doc, last FROM hit), found AS (SELECT s.doc, s.pos, start, length FROM spots s JOIN idx USING (doc, pos) WHERE set = 'no_symbols')"


@query("fts10_phrase_ranges", f"{_DE_LA} SELECT doc, pos AS position, CAST(start AS INT) AS start, CAST(length AS INT) AS length FROM found")
def fts10_ranges(spark, root):
    """A phrase, from tokens to character ranges."""
    index = index_of(spark, root)
    found = ranges(index, search(index, Phrase((Term("de"), Term("la"))), "no_symbols"), "no_symbols")
    return found.select("doc", F.explode(F.arrays_zip("positions", "ranges")).alias("x")).select("doc", F.col("x.positions").cast("long").alias("position"), "x.ranges.start", "x.ranges.length")


@query("fts10_phrase_regions", f"""{_DE_LA}, lined AS (SELECT found.doc, pos, len(string_split(left(text, CAST(start AS BIGINT)), chr(10))) - 1 AS line, len(string_split(text, chr(10))) AS lines FROM found JOIN raw USING (doc)),
spans AS (SELECT doc, pos, greatest(0, line - 2) AS a, least(lines, line + 3) AS b FROM lined),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc ORDER BY a, b, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY a, b, pos ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT doc, CAST(min(a) AS INT) AS first_line, CAST(max(b) AS INT) AS last_line, CAST(count(*) AS INT) AS hits FROM islands GROUP BY doc, island""")
def fts10_regions(spark, root):
    """The same hits with two lines on either side, merged."""
    index = index_of(spark, root)
    found = ranges(index, search(index, Phrase((Term("de"), Term("la"))), "no_symbols"), "no_symbols")
    return regions(found, table(spark, root, "documents"), "doc_id", "text").select("doc", "first_line", "last_line", "hits")
