"""Functions on text columns: tokenizers, cleaning, word classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The tokens of ``tokenize``, and what lies between them.
TOKEN = r"""aujourd'hui|[^ \t\n\r,;:.?!"']*'|[^ \t\n\r,;:.?!"']+|[,;:.?!"]"""
GAP = r"[ \t\n\r]+"


def tokenize(text: Column) -> Column:
    """Words, with ``,;:.?!"`` as tokens and a cut after an apostrophe; ``aujourd'hui`` stays whole."""
    plain = F.regexp_replace(text, "’", "'")
    return F.regexp_extract_all(plain, F.lit(f"({TOKEN})"))


def offsets(text: Column) -> Column:
    """Array of (form, begin, end): tokens of ``tokenize`` with their places, end exclusive."""
    plain = F.regexp_replace(text, "’", "'")
    start = F.struct(F.array().cast("array<struct<form:string,begin:int,end:int>>").alias("out"), F.lit(1).alias("at"))

    def add(acc: Column, token: Column) -> Column:
        place = F.call_function("locate", token, plain, acc["at"])
        span = F.struct(token.alias("form"), (place - 1).cast("int").alias("begin"), (place - 1 + F.length(token)).cast("int").alias("end"))
        return F.struct(F.concat(acc["out"], F.array(span)).alias("out"), (place + F.length(token)).cast("int").alias("at"))

    return F.aggregate(tokenize(text), start, add)["out"]


def without_comments(text: Column) -> Column:
    """Without ``[...]`` and ``(...)``."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]|\([^)]*\)", " "), " +", " "))


def without_punctuation(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r'[,;:.?!"]', " "), " +", " "))


def spoken(text: Column) -> Column:
    """For comparing words: lower case, ``_-'=`` as spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "_-'=", "    ")), " +", " "))


def number_class(token: Column) -> Column:
    """entier, reel, acronyme, bizarre or nan."""
    return (
        F.when(token.rlike(r"^[0-9]+$"), "entier")
        .when(token.rlike(r"^[0-9]+[.,][0-9]+$"), "reel")
        .when(token.rlike(r"^[A-Z]{2,}$"), "acronyme")
        .when(token.rlike(r"[0-9]"), "bizarre")
        .otherwise("nan")
    )


def broad(pos: Column) -> Column:
    """The tag before its colon."""
    return F.substring_index(pos, ":", 1)


def is_punctuation(form: Column) -> Column:
    return form.rlike(r"^\p{P}+$")


def feature(feats: Column, name: str) -> Column:
    """One value of ``a=b|c=d`` features."""
    return F.try_element_at(F.str_to_map(feats, F.lit(r"\|"), F.lit("=")), F.lit(name))


def add_note(comment: Column, word: str) -> Column:
    return F.when(F.coalesce(comment, F.lit("")) == "", F.lit(word)).when(F.array_contains(F.split(comment, " "), word), comment).otherwise(F.concat(comment, F.lit(" " + word)))


def drop_note(comment: Column, word: str) -> Column:
    return F.array_join(F.array_remove(F.split(comment, " "), word), " ")
