"""Arrow UDFs for the three text rules Spark has no builtin for.

Callers pass NULL for rows that do not need the rule, so only the few rows
that do are sent to Python.
"""
from __future__ import annotations

import functools
import html
import operator
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry import constants as C

# Characters outside these blocks may change under NFKC (compatibility forms,
# combining marks, half- and full-width forms, ...). The listed blocks hold only
# characters that are already normal.
_STABLE = (
    r"\x00-\x7f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\x{131}\x{134}-\x{13e}"
    r"\x{141}-\x{148}\x{14a}-\x{17e}\x{391}-\x{3a1}\x{3a3}-\x{3ce}"
    r"\x{400}-\x{482}\x{48a}-\x{52f}\x{5d0}-\x{5ea}\x{621}-\x{64a}\x{905}-\x{928}\x{e01}-\x{e30}"
    r"\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{3001}-\x{3020}\x{3041}-\x{3096}"
    r"\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}"
)
# ASCII, most of any text, is put aside first: the long classes see the other characters only.
_NOT_STABLE = rf"[[^\x00-\x7f]&&[^{_STABLE}]]"
# Western European text is settled by this much cheaper test.
_NOT_LATIN = (
    r"[[^\x00-\x7f]&&[\xa0\xa8\xaa\xaf\xb2\xb3\xb4\xb5\xb8\xb9\xba\xbc\xbd\xbe"
    r"\x{132}\x{133}\x{13f}\x{140}\x{149}\x{17f}-\x{10ffff}]]"
)


def needs_nfkc(text: Column) -> Column:
    """False for ASCII (equal byte and character counts) and other text that is
    already in normal form."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(_NOT_LATIN) & text.rlike(_NOT_STABLE)


# An ampersand that could open an HTML entity.
NEEDS_UNESCAPE = r"&(?:#|[a-zA-Z])"


_ZERO_WIDTH = re.compile("[\u200b\u200c\u200d\u200e\u200f\ufeff\x00]")
_STEPS = {
    "nfkc": lambda s: unicodedata.normalize("NFKC", s),
    "lookalikes": lambda s: s.translate(str.maketrans(C.LOOKALIKE_FROM, C.LOOKALIKE_TO)),
    "zero_width": lambda s: _ZERO_WIDTH.sub("", s),
    "html_entities": lambda s: _storable(html.unescape(s)),
}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _idna(labels: pd.Series) -> pd.Series:
    return labels.map(lambda row: None if row is None else [_decode_label(x) for x in row])


def _storable(text: str) -> str:
    """Lone surrogates cannot be stored in a Spark string."""
    return re.sub("[\ud800-\udfff]", "\ufffd", text)


def _decode_label(label: str) -> str:
    try:
        return label.encode("utf-8").decode("idna")
    except (UnicodeError, ValueError):
        return label


def normalize(text: Column, rules: Sequence[str], builtin: Column) -> Column:
    """Apply the character rules, in order, to the rows where Unicode normal form
    or HTML entities can matter; all other rows take the ``builtin`` expression.
    """
    steps = [_STEPS[name] for name in _STEPS if name in rules]

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        def one(s):
            for step in steps:
                s = step(s)
            return s

        return column.map(one, na_action="ignore")

    guards = {"nfkc": needs_nfkc, "html_entities": lambda t: t.rlike(NEEDS_UNESCAPE)}
    needed = [guards[name](text) for name in guards if name in rules]
    if not needed:
        return builtin
    return F.coalesce(run(F.when(functools.reduce(operator.or_, needed), text)), builtin)


PUNYCODE = r"(?iU)\bxn--[a-zA-Z0-9-]+\b"


def decode_punycode(text: Column) -> Column:
    """Only the labels themselves travel to Python, not the text around them."""
    may_hold = text.contains("n--") | text.contains("N--")
    labels = F.when(may_hold & text.rlike(PUNYCODE), F.regexp_extract_all(text, F.lit(PUNYCODE), F.lit(0)))
    decoded = _idna(labels)
    pairs = F.zip_with(
        F.split(text, PUNYCODE, -1),
        F.concat(decoded, F.array(F.lit(""))),
        lambda gap, label: F.concat(gap, label),
    )
    return F.when(decoded.isNotNull(), F.array_join(pairs, "")).otherwise(text)
