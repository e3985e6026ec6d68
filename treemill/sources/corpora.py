"""Corpora as wholes: reading and writing by the kind of file, and putting corpora together."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treemill.sources import columns, conll, constituents, other

#: The kind of a file by its ending.
KINDS = {"conll": "06", "conll06": "06", "conllx": "06", "conll08": "08", "conll09": "09", "xml": "xml", "mrg": "brackets", "ftb": "constituents"}
TOKENS = "sent_id long, idx int, form string, lemma string, pos string"
ARCS = "sent_id long, gov int, head int, label string"
GROUPS = "sent_id long, name string, first_idx int, last_idx int"


@dataclass(frozen=True)
class Corpus:
    """Words, arcs, roles and groups of the same sentences."""

    tokens: DataFrame
    deps: DataFrame
    roles: DataFrame
    groups: DataFrame

    def each(self, change) -> Corpus:
        """The corpus with ``change`` made to each of its tables."""
        return Corpus(*map(change, (self.tokens, self.deps, self.roles, self.groups)))


def kind_of(path: str) -> str:
    """The kind of a file by its ending; ``*`` and compression endings are looked through."""
    name = path.rstrip("/*").removesuffix(".gz").removesuffix(".bz2").rsplit("/", 1)[-1]
    kind = KINDS.get(name.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"no known ending: {path}")
    return kind


def _uniform(spark: SparkSession, tokens: DataFrame, deps: DataFrame | None, roles: DataFrame | None, groups: DataFrame | None) -> Corpus:
    if "lemma" not in tokens.columns:
        tokens = tokens.withColumn("lemma", F.col("form"))
    empty = lambda schema: spark.createDataFrame([], schema)
    pick = lambda df, schema: empty(schema) if df is None else df.select(*[F.col(c).cast(t) for c, t in (x.split(" ") for x in schema.split(", "))])
    extra = [c for c in ("sense", "extra") if c in tokens.columns]
    words = tokens.select(*[F.col(c).cast(t) for c, t in (x.split(" ") for x in TOKENS.split(", "))], *extra)
    return Corpus(words, pick(deps, ARCS), pick(roles, ARCS), pick(groups, GROUPS))


def load(spark: SparkSession, path: str, kind: str | None = None) -> Corpus:
    """The corpus in a file, a folder or a pattern, by its ending or ``kind``."""
    kind = kind or kind_of(path)
    if kind in ("06", "08", "09"):
        return _uniform(spark, *conll.read(spark, path, kind), None)
    if kind == "xml":
        words, arcs, groups = other.read_xml(spark, path)
        return _uniform(spark, words, arcs, None, groups)
    if kind == "brackets":
        return _uniform(spark, other.brackets(spark, path), None, None, None)
    if kind == "constituents":
        words, groups = constituents.read_constituents(spark, path)
        return _uniform(spark, words, None, None, groups)
    raise ValueError(f"unknown kind: {kind}")


def save(corpus: Corpus, path: str, kind: str) -> None:
    """Writes a corpus in one of the kinds that have a writer, as sorted part files."""
    tokens = corpus.tokens if "sense" in corpus.tokens.columns else corpus.tokens.withColumn("sense", F.lit(None).cast("string"))
    if kind == "06":
        lines = conll.lines06(corpus.tokens, corpus.deps)
    elif kind == "08":
        lines = columns.lines08(tokens, corpus.deps, corpus.roles)
    elif kind == "09":
        lines = conll.lines09(tokens, corpus.deps, corpus.roles)
    elif kind == "xml":
        lines = other.xml_lines(corpus.tokens, corpus.deps, corpus.groups)
    elif kind == "brackets":
        lines = columns.bracket_lines(corpus.tokens, corpus.groups)
    else:
        raise ValueError(f"no writer for {kind}")
    conll.write(lines, path)


def convert(spark: SparkSession, source: str, target: str, to: str, kind: str | None = None) -> None:
    """A file in another kind; what the new kind has no place for is left out."""
    save(load(spark, source, kind), target, to)


def append(*corpora: Corpus) -> Corpus:
    """Corpora one after another, their sentences numbered on; only the greatest number of each comes to the driver."""

    def after(first: Corpus, second: Corpus) -> Corpus:
        offset = (first.tokens.agg(F.max("sent_id")).first()[0] or 0) + 1 if not first.tokens.isEmpty() else 0
        moved = second.each(lambda df: df.withColumn("sent_id", F.col("sent_id") + offset))
        return Corpus(*[a.unionByName(b, allowMissingColumns=True) for a, b in zip(_tables(first), _tables(moved), strict=True)])

    return reduce(after, corpora)


def interleave(*corpora: Corpus) -> Corpus:
    """Sentence i of each corpus in turn: its new number is i times their number, plus the corpus's place."""
    placed = [c.each(lambda df, k=k: df.withColumn("sent_id", F.col("sent_id") * len(corpora) + k)) for k, c in enumerate(corpora)]
    return reduce(lambda a, b: Corpus(*[x.unionByName(y, allowMissingColumns=True) for x, y in zip(_tables(a), _tables(b), strict=True)]), placed)


def levels(*corpora: Corpus) -> Corpus:
    """Annotations of the same sentences as levels 0, 1 ... of one corpus."""
    marked = [c.each(lambda df, k=k: df.drop("level").withColumn("level", F.lit(k))) for k, c in enumerate(corpora)]
    return reduce(lambda a, b: Corpus(*[x.unionByName(y, allowMissingColumns=True) for x, y in zip(_tables(a), _tables(b), strict=True)]), marked)


def level(corpus: Corpus, n: int) -> Corpus:
    """One level of a corpus."""
    return corpus.each(lambda df: df.where(F.col("level") == n).drop("level"))


def put_level(corpus: Corpus, n: int, new: Corpus) -> Corpus:
    """A corpus whose level ``n`` is ``new``, whether or not it had one."""
    rest = corpus.each(lambda df: df.where(F.col("level") != n))
    added = new.each(lambda df: df.drop("level").withColumn("level", F.lit(n)))
    return Corpus(*[a.unionByName(b, allowMissingColumns=True) for a, b in zip(_tables(rest), _tables(added), strict=True)])


def without_arcs(corpus: Corpus, keep: str = "false", roles: bool = False) -> Corpus:
    """Without its arcs but those that meet ``keep`` (SQL over label, gov and head), or without its roles."""
    return replace(corpus, roles=corpus.roles.where(keep)) if roles else replace(corpus, deps=corpus.deps.where(keep))


def _tables(c: Corpus) -> tuple[DataFrame, ...]:
    return c.tokens, c.deps, c.roles, c.groups
