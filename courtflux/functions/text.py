"""Strings: OCR digits, token decoding, labels, log lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def parse_digits(text: Column) -> Column:
    """The first two digits of a text as a number 0..99, else null."""
    digits = F.substring(F.regexp_replace(text, "[^0-9]", ""), 1, 2)
    return F.when(F.length(digits) > 0, digits.cast("int"))


def normalized_edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def greedy_tokens(ids: Column, charset: Column, eos: int = 0) -> Column:
    """Characters of token ids up to the first end token; id 0 is the end, id i the i-th character."""
    stop = F.array_position(ids, eos)
    own = F.when(stop > 0, F.slice(ids, 1, (stop - 1).cast("int"))).otherwise(ids)
    return F.array_join(F.transform(own, lambda i: F.substr(charset, i.cast("int"), F.lit(1))), "")


def ctc_collapse(ids: Column, blank: int = 0) -> Column:
    """Without repeats of the token before, then without blanks."""
    kept = F.filter(F.transform(ids, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(ids, i - 1)).alias("before"))), lambda p: ~p["x"].eqNullSafe(p["before"]) & (p["x"] != blank))
    return F.transform(kept, lambda p: p["x"])


def ascii_only(text: Column) -> Column:
    """NFKD, then what is ASCII; no built-in function decomposes characters, so texts that have others than ASCII go to Python."""

    def bare(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())

    beyond = text.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, pandas_udf(bare, "string")(F.when(beyond, text))).otherwise(text)


def label(text: Column, charset: str, longest: int = 25) -> Column:
    """A clean OCR label: no white space, characters of the charset only; null if empty or too long."""
    bare = F.regexp_replace(text, r"\s+", "")
    from re import escape

    clean = F.regexp_replace(bare, f"[^{escape(charset)}]", "")
    return F.when((F.length(bare) <= longest) & (F.length(clean) > 0), clean)


def log_line(level: Column, source: Column, message: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("["), level, F.lit("]")), F.concat(F.lit("["), source, F.lit("]")), message)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def file_name(name: Column) -> Column:
    """An upload's name without folders, unsafe characters replaced."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?U)[^\w\-. ]", "_")
    return F.when(base == "", "video.mp4").otherwise(base)
