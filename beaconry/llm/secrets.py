"""Operator 10: secret scan by token efficiency.

Three base patterns find assigned values, access keys and hex strings. The method
adds what no pattern names: a run of key characters that a byte-pair vocabulary
cannot shorten. Such a vocabulary spends a token on three or four characters of
language but on about one and a half of a random string, so a low ratio of
characters to tokens exposes it. Runs that are known digests (pure hex), UUIDs,
plain numbers and dates are left out before the test, and so are base spans; what
lies before and after them is tested. Paths and host names made of words take the test
like any run; their words keep the ratio high. A run needs 20 characters and two of
the classes lower case, upper case and digits. A
run that is not random as a whole is divided at =, then /, then _, then -, and its
parts are tested alike, so words joined to a secret do not hide it.

Positions are code points. Defined results: null and empty texts have no spans and
the digest of the empty string; repeated rows are scanned alike; a null doc_id is
reported as null; an empty table gives an empty table. Only doc_id and text are read.
"""
from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm.common import map_rows, table
from beaconry.llm.encode import default_path

BYTE_BPE = "byte_bpe_50k.tiktoken"
#: A run is random when it has at most so many characters a token.
RATIO = 2.0
#: Shortest run that is tested; shorter ones do not tell language from chance.
LEAST = 20
#: Where a run that is not random as a whole is divided, in this order: words before a secret lift its ratio.
MARKS = "=/_-"
KINDS = ("assign", "access", "hex", "random")

# fixed values: the base patterns
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # maximal runs of 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")

_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_KNOWN = re.compile(
    r"[0-9a-fA-F]+|[0-9+/_=-]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-]?[0-9-]*"
)
_CLASSES = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), leftmost and not overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _random(text: str, start: int, end: int, marks: str, encode) -> list[tuple[int, int, int]]:
    """The run itself where it is random, or else what is found between the first of ``marks``, and so on."""
    run = text[start:end]
    if len(run) < LEAST or _KNOWN.fullmatch(run) or sum(bool(c.search(run)) for c in _CLASSES) < 2:
        return []
    if len(run) <= RATIO * len(encode(run)):
        return [(start, 3, end)]
    while marks and marks[0] not in run:
        marks = marks[1:]
    out = []
    for part in run.split(marks[0]) if marks else ():
        out += _random(text, start, start + len(part), marks[1:], encode)
        start += len(part) + 1
    return out


def random_spans(text: str, taken: list[tuple[int, int, int]], encode) -> list[tuple[int, int, int]]:
    out = []
    for m in _RUN.finditer(text):
        at = m.start()
        for start, _, end in taken:  # in order of their starts
            if start < m.end() and at < end:
                out += _random(text, at, max(at, start), MARKS, encode)
                at = min(end, m.end())
        out += _random(text, at, m.end(), MARKS, encode)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_READY: dict = {}


def _encode(path: str):
    if path not in _READY:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _READY[path] = made.encode_ordinary
    return _READY[path]


def scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    path = path or default_path(BYTE_BPE)

    def each(rows: dict) -> dict:
        encode = _encode(path)
        out: dict[str, list] = {"doc_id": rows["doc_id"], **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
        for text in rows["text"]:
            base = base_spans(text or "")
            spans = sorted(base + random_spans(text or "", base, encode))
            for number, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(k == number for _, k, _ in spans))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    read = docs.select(F.col("doc_id").cast("long"), "text")
    return map_rows(read, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string", each)


def op10_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
