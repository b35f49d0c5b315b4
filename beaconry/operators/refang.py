"""Undo text masking ("refang") as a column job over a documents table.

Every rule is one SQL expression built from Spark builtins; the whole chain is a
narrow projection, so it runs inside the scan stage without a shuffle. The rules
that need Python (see ``functions.unicode``) send it only the rows that need them.

Rule functions take the SQL text of a string expression and return SQL text.
"""
from __future__ import annotations

import string
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry import constants as C
from beaconry.functions import unicode as U
from beaconry.functions.columns import with_computed
from beaconry.functions.sqltext import any_contains, kept, let, literals, mapped, only_if, q, splice, sub, subs, subs_if

# Whole runs of the alphabet; single letters in a class are a table look-up, ranges are not.
# A run is tried only behind another character (a blank is put before the text), not at each of its letters.
_B64_RUN = f"[^{string.ascii_letters}{string.digits}+/=]([{string.ascii_letters}{string.digits}+/=]{{16,}}+)"
_B64_FORM = "^[A-Za-z0-9+/]{16,}={0,2}$"
_B64_MAX = 4096
# Decoded bytes are ASCII indicators or noise: word edges and digits are those of ASCII, so a
# letter of another script right behind a name does not hide it. Each pattern comes with a
# cheap test that must hold first.
_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_B64_WORTH_KEEPING = [
    ("contains({0}, '.')", rf"{_BEFORE}(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{_AFTER}"),
    ("contains({0}, '://')", r"(?iu)https?://"),
    ("contains({0}, '.')", rf"(?:{_BEFORE}[a-zA-Z0-9]|(?<=[A-Za-z0-9_])-)[a-zA-Z0-9-]*\.[a-zA-Z]{{2,}}{_AFTER}"),
    ("length({0}) >= 32", rf"{_BEFORE}[a-fA-F0-9]{{32,64}}{_AFTER}"),
    ("length({0}) >= 17", rf"{_BEFORE}(?:[0-9a-fA-F]{{2}}[:-]){{5}}[0-9a-fA-F]{{2}}{_AFTER}"),
]
_B64_MARKER = "\n\n[DECODED_BASE64_IOCS]\n"


def _beyond_ascii(text: str) -> str:
    return f"octet_length({text}) <> length({text})"


# --- characters -------------------------------------------------------------
def unicode_escapes(text: str) -> str:
    r"""``\uXXXX``, ``\xXX`` and octal ``\NNN`` escapes become characters."""

    def code_unit(hexes: str, original: str) -> str:
        # a lone surrogate cannot be stored in a string: leave the escape
        return let(hexes, lambda h: f"if({h} rlike '^[dD][89a-fA-F]', {original}, decode(unhex({h}), 'UTF-16BE'))")

    def rewrite(t: str) -> str:
        t = splice(t, r"\\u([0-9a-fA-F]{4})", lambda m: code_unit(f"substring({m}, 3, 4)", m))
        t = splice(t, r"\\x([0-9a-fA-F]{2})", lambda m: code_unit(f"concat('00', substring({m}, 3, 2))", m))
        return splice(
            t, r"\\([0-3][0-7]{2})", lambda m: code_unit(f"lpad(conv(substring({m}, 2, 3), 8, 16), 4, '0')", m)
        )

    any_escape = q(r"\\[ux0-3][0-9a-fA-F]{2}")
    return only_if(text, lambda t: f"contains({t}, {q(chr(92))}) and {t} rlike {any_escape}", rewrite)


def lookalikes(text: str) -> str:
    """Cyrillic letters that imitate Latin ones become Latin."""
    letters = q(f"[[^\\x00-\\x7f]&&[{C.LOOKALIKE_FROM}]]")
    return only_if(text, lambda t: f"{_beyond_ascii(t)} and {t} rlike {letters}", lambda t: f"translate({t}, {q(C.LOOKALIKE_FROM)}, {q(C.LOOKALIKE_TO)})")


def zero_width(text: str) -> str:
    may_hold = q(r"[\x00\x{200b}-\x{200f}\x{feff}]")  # the same characters in fewer steps
    return only_if(text, lambda t: f"({_beyond_ascii(t)} or contains({t}, chr(0))) and {t} rlike {may_hold}", lambda t: sub(t, C.ZERO_WIDTH, ""))


# --- encodings --------------------------------------------------------------
def base64_runs(text: str) -> str:
    """Append decoded base64 runs that carry an indicator, under a marker line."""

    def decode(run: str) -> str:
        def padded(data: str) -> str:
            fill = f"repeat('=', int(pmod(-length({data}), 4)))"
            raw = f"if(length({data}) % 4 <> 1, try_to_binary(concat({data}, {fill}), 'base64'), null)"
            # undecodable bytes are dropped
            return f"replace(make_valid_utf8(cast({raw} as string)), '\ufffd', '')"

        return let(f"rtrim('=', {run})", padded)

    def worth_keeping(text: str) -> str:
        hit = " or ".join(f"({guard.format(text)} and {text} rlike {q(p)})" for guard, p in _B64_WORTH_KEEPING)
        return f"length({text}) <= {_B64_MAX} and ({hit})"

    def rewrite(t: str) -> str:
        runs = kept(f"regexp_extract_all(concat(' ', {t}), {q(_B64_RUN)}, 1)", lambda r: f"length({r}) <= {2 * _B64_MAX} and {r} rlike {q(_B64_FORM)}")
        found = kept(mapped(runs, decode), worth_keeping)
        marker = q(_B64_MARKER)
        return let(found, lambda f: f"if(size({f}) > 0, concat({t}, {marker}, array_join({f}, '\n')), {t})")

    return let(text, rewrite)


# --- structure --------------------------------------------------------------
def markdown(text: str) -> str:
    rules = [
        (["](http"], r"\[([^\]]+)\]\((https?://[^\)]+)\)", "$1"),
        (["<"], r"<([^>]+)>", "$1"),
        (["`"], r"(?U)(?<!\w)`([^`\s]+)`(?!\w)", "$1"),
        (["**"], r"(?U)(?<!\w)\*\*([^\*\s]+)\*\*(?!\w)", "$1"),
        (["_"], r"(?U)(?<!\w)_([^\_\s]+)_(?!\w)", "$1"),
    ]
    return subs_if(text, rules)


def split_lines(text: str) -> str:
    """Re-join indicators that a line break cut in two."""
    rules = [
        (r"(?U)([a-zA-Z0-9-])[ \t]*\r?\n[ \t]*\.([a-zA-Z]{2,})\b", "$1.$2"),
        (r"(?U)(\b\d{1,3}\.\d{1,3})[ \t]*\r?\n[ \t]*(\.\d{1,3}\.\d{1,3}\b)", "$1$2"),
        (r"(?U)(\b\d{1,3}\.\d{1,3}\.\d{1,3})?[ \t]*\r?\n[ \t]*(\.\d{1,3}\b)", "$1$2"),
    ]
    url_rule = (r"(https?://[a-zA-Z0-9\.-]+)[ \t]*\r?\n[ \t]*([a-zA-Z0-9/_\.-]+)", "$1$2")
    line_starts_with_dot = q(r"\n[ \t]*\.")

    def rewrite(t: str) -> str:
        t = only_if(t, lambda x: f"{x} rlike {line_starts_with_dot}", lambda x: subs(x, rules))
        return only_if(t, lambda x: f"contains({x}, '://')", lambda x: subs(x, [url_rule]))

    return only_if(text, lambda t: f"contains({t}, '\n')", rewrite)


# --- punctuation ------------------------------------------------------------
def brackets(text: str) -> str:
    def rewrite(t: str) -> str:
        t = literals(
            t,
            [("%5B", "["), ("%5D", "]"), ("%5b", "["), ("%5d", "]"), ("%28", "("), ("%29", ")"),
             ("%7B", "{"), ("%7D", "}"),
             ("[://]", "://"), ("[:]//", "://"), ("[://", "://"), ("://]", "://"),
             ("(://)", "://"), ("{://}", "://")],
        )
        return subs_if(
            t,
            [(["]://", ")://"], r"(?i)http(?:\[s\]|\(s\))://", "https://"),
             (["["], r"\[([a-zA-Z0-9_-])\]", "$1"), (["("], r"\(([a-zA-Z0-9_-])\)", "$1"),
             (["{"], r"\{([a-zA-Z0-9_-])\}", "$1")],
        )

    return only_if(text, lambda t: any_contains(t, ["[", "]", "(", "{", "%5", "%2", "%7"]), rewrite)


def dots(text: str) -> str:
    spaced = q(r"(?U)\.(?<=\s\.)\s")  # starts at the dot: far fewer places to try

    def rewrite(t: str) -> str:
        t = only_if(
            t, lambda x: any_contains(x, C.UNICODE_DOTS),
            lambda x: f"translate({x}, {q(C.UNICODE_DOTS)}, {q('.' * len(C.UNICODE_DOTS))})",
        )
        t = literals(t, [("%2E", "."), ("%2e", "."), ("[.]", "."), ("(.)", "."), ("{.}", ".")])
        closed = q(r"[\])}>](?<=[tT].)")
        t = only_if(
            t, lambda x: f"{x} rlike {closed}",
            lambda x: sub(x, r"(?i)\[(?:d0t|dt|dot)\]|\(dot\)|\{dot\}|<dot>", "."),
        )
        t = subs_if(t, [(["DOT"], r"(?U)\bDOT\b", ".")])
        return only_if(
            t,
            lambda x: f"{x} rlike {spaced}",
            lambda x: sub(x, r"(?U)\b([a-zA-Z0-9_.-]+)\s+\.\s+([a-zA-Z0-9_-]+)\b", "$1.$2"),
        )

    marks = ["[", "(", "{", "<", "DOT", "%2E", "%2e", *C.UNICODE_DOTS]
    return only_if(text, lambda t: f"({any_contains(t, marks)} or {t} rlike {spaced})", rewrite)


def slashes(text: str) -> str:
    rules = [("\\/", "/"), ("[/]", "/"), ("&#47;", "/"), ("%252F", "%2F"), ("%252f", "%2f")]
    return only_if(text, lambda t: any_contains(t, ["\\/", "[/]", "&#47;", "%252"]), lambda t: literals(t, rules))


def at_signs(text: str) -> str:
    rules = [
        (["[at]", "[At]", "[aT]", "[AT]"], r"(?iU)\s*\[at\]\s*", "@"),
        (["("], r"(?iU)\s*\(\s*at\s*\)\s*", "@"),
        (["[@]"], r"(?U)\s*\[@\]\s*", "@"),
        (["AT"], r"(?U)\s*\bAT\b\s*", "@"),
    ]
    return literals(subs_if(text, rules), [("＠", "@")])


# --- formats ----------------------------------------------------------------
def url_schemes(text: str) -> str:
    """``hxxp``-like schemes become http, or https when the match holds an s."""
    sep = r"(://|%3a%2f%2f)"
    rules = [
        (rf"(?iU)h(?:[a-z*_-]{{1,2}}ps|(?:s[a-z*_-]?|[a-z*_-]s)p){sep}", "https$1"),
        (rf"(?iU)h[a-z*_-]{{1,2}}p{sep}", "http$1"),
    ]
    others = [(["xp://", "XP://", "xP://", "Xp://"], r"(?iU)\bfxp(://)", "ftp$1"),
              (["w://", "W://"], r"(?iU)\bmeow(://)", "http$1")]

    def rewrite(t: str) -> str:
        return literals(subs_if(subs(t, rules), others), [("%253A", "%3A"), ("%253a", "%3a")])

    return only_if(text, lambda t: any_contains(t, ["://", "%3", "%25"]), rewrite)


def dotted(number: str) -> str:
    """IPv4 text of an unsigned 32-bit number."""
    octets = [f"string(shiftright({number}, {shift}) & 255)" for shift in (24, 16, 8, 0)]
    return f"concat_ws('.', {', '.join(octets)})"


def ip_encodings(text: str) -> str:
    """Bracketed, spaced, hexadecimal, decimal and mixed-base IPv4 forms."""
    quad = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
    part = r"(0[xX][0-9a-fA-F]+|0[0-7]*|\d{1,3})"
    mixed = rf"(?U)\b{part}\.{part}\.{part}\.{part}\b"
    leading_zero = q(r"0[0-9xX](?:(?<=\.0[0-9xX])|[0-9a-fA-F]*\.)")
    unwrap = [
        (["["], rf"(?U)\[({quad})\]", "$1"), (["("], rf"(?U)\(({quad})\)", "$1"), (["{"], rf"(?U)\{{({quad})\}}", "$1"),
    ]
    spaced_dot = q(r"(?U)\.(?<=\s\.)\s")
    spaced = r"(?U)\b(\d{1,3})\s+\.\s+(\d{1,3})\s+\.\s+(\d{1,3})\s+\.\s+(\d{1,3})\b"
    # the first digit settles nearly all places before the costly word edge is asked
    hexadecimal = r"(?U)0(?<=\b0)[xX][0-9a-fA-F]{8}\b"
    decimal = r"(?U)\d(?<=\b\d)(?:(?<=[1-3])\d{9}|\d{7,8})\b"

    def hex_ip(m: str) -> str:
        return let(f"bigint(conv(substring({m}, 3, 8), 16, 10))", dotted)

    def decimal_ip(m: str) -> str:
        number = f"bigint(if(startswith({m}, '0'), conv({m}, 8, 10), {m}))"
        bad_octal = f"startswith({m}, '0') and not {m} rlike '^[0-7]+$'"
        return let(number, lambda n: f"if(({bad_octal}) or {n} > 4294967295, {m}, {dotted(n)})")

    def mixed_ip(m: str) -> str:
        # an octal part with digits 8 or 9 is no number: the match stays as it is
        def one(p: str) -> str:
            return (
                f"case when {p} rlike '^0[xX]' then conv(substring({p}, 3, 100), 16, 10) "
                f"when startswith({p}, '0') and length({p}) > 1 "
                f"then if({p} rlike '^[0-7]+$', conv({p}, 8, 10), null) else {p} end"
            )

        parts = mapped(f"split({m}, '[.]')", one)
        return let(parts, lambda a: f"if(exists({a}, p -> p is null), {m}, array_join({a}, '.'))")

    def rewrite(t: str) -> str:
        t = subs_if(t, unwrap)
        t = only_if(t, lambda x: f"{x} rlike {spaced_dot}", lambda x: sub(x, spaced, "$1.$2.$3.$4"))
        t = only_if(t, lambda x: any_contains(x, ["0x", "0X"]), lambda x: splice(x, hexadecimal, hex_ip))
        t = splice(t, decimal, decimal_ip)
        # only parts with a leading zero change
        return only_if(t, lambda x: f"{x} rlike {leading_zero}", lambda x: splice(x, mixed, mixed_ip))

    any_digit = q(r"(?U)\d")
    return only_if(text, lambda t: f"{t} rlike {any_digit}", rewrite)


def cve_forms(text: str) -> str:
    return only_if(
        text,
        lambda t: f"{t} rlike '[cC][vV][eE]'",
        lambda t: sub(t, r"(?iU)(?-i:[cC])(?<=\bc)ve[_\.#\-\s]+(\d{4})[_\.#\-\s]+(\d{4,})\b", "CVE-$1-$2"),
    )


# --- prose ------------------------------------------------------------------
# Whole words of plain prose between two plain words, 40 characters at least; letters are listed
# one by one, as such a class is a table look-up.
_LETTERS = string.ascii_letters
_PLAIN = _LETTERS + "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())
_STRETCH = rf" (?<=[{_LETTERS}] )[{_LETTERS}][{_PLAIN} ,.;!?'\n]{{40,}}[{_LETTERS}](?= [{_LETTERS}])"
# What rules could change within one: a dot behind white space, AT and DOT.
_NOT_PROSE = r"[.T](?:(?<=[ \n]\.)|(?<=[AO]T))"
# A letter that normal form replaces, so texts hardly hold it, and that no rule makes.
_STAND_IN = "\u00aa"


def beside_prose(text: str, rewrite: Callable[[str], str]) -> str:
    """``rewrite`` with a one-letter word for each stretch of prose, which costs as much to search as any
    text and which no rule changes. Rules look no farther than the next word, and that stays; the one
    that drops text, a link's address, must not drop a stretch. Texts in doubt are rewritten as they are."""
    in_link = q(rf"\]\(https?://[^)]*{_STAND_IN}")

    def put_back(clean: str, stretches: str) -> str:
        pieces = (
            f"transform(split({clean}, '{_STAND_IN}', -1), (gap, i) -> "
            f"if(i = 0, gap, concat(coalesce(substring(get({stretches}, i - 1), 2), '{_STAND_IN}'), gap)))"
        )
        return f"if(size({stretches}) > 0, array_join({pieces}, ''), {clean})"

    def apart(t: str) -> str:
        found = f"if(contains({t}, '{_STAND_IN}'), null, regexp_extract_all({t}, {q(_STRETCH)}, 0))"
        stretches = let(found, lambda a: f"if(exists({a}, s -> s rlike {q(_NOT_PROSE)}), null, {a})")

        def with_stretches(a: str) -> str:
            short = f"if(size({a}) > 0, {sub(t, _STRETCH, f' {_STAND_IN}')}, {t})"

            def sure(x: str) -> str:
                lost = f"contains({x}, '](http') and {x} rlike {in_link}"
                return f"if(size({a}) > 0 and {lost}, named_struct('t', {t}, 'a', null), named_struct('t', {x}, 'a', {a}))"

            return let(let(short, sure), lambda b: let(rewrite(f"{b}.t"), lambda c: put_back(c, f"{b}.a")))

        return let(stretches, with_stretches)

    return let(text, apart)


# Rules in the order they apply. The first group concerns single characters, the
# second is the builtin chain, the last needs the chain's result.
CHARACTER_RULES = ["unicode_escapes", "nfkc", "lookalikes", "zero_width", "html_entities"]
CHAIN = {
    "base64_runs": base64_runs,
    "markdown": markdown,
    "split_lines": split_lines,
    "brackets": brackets,
    "dots": dots,
    "slashes": slashes,
    "at_signs": at_signs,
    "url_schemes": url_schemes,
    "ip_encodings": ip_encodings,
    "cve_forms": cve_forms,
}
RULES = [*CHARACTER_RULES, *CHAIN, "punycode"]


def refang(
    docs: DataFrame, text: str = "text", clean: str = "clean", skip: Iterable[str] = ()
) -> DataFrame:
    """Add ``clean`` (rewritten text) and ``was_modified``.

    ``skip`` names rules to leave out, for example ``ip_encodings`` to stop bare
    8-10 digit numbers from being read as addresses.
    """
    skipped = set(skip)
    unknown = skipped - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    use = [name for name in RULES if name not in skipped]

    out = docs.withColumn(clean, F.expr(unicode_escapes(text) if "unicode_escapes" in use else text))
    builtin = clean
    if "lookalikes" in use:
        builtin = lookalikes(builtin)
    if "zero_width" in use:
        builtin = zero_width(builtin)
    out = out.withColumn(clean, U.normalize(F.col(clean), use, F.expr(builtin)))

    first, *later = [name for name in CHAIN if name in use] or [None]
    chain = clean
    if first == "base64_runs":  # reads words of any kind, so it comes before prose is set aside
        chain = base64_runs(chain)
    elif first:
        later = [first, *later]

    def rules(t: str) -> str:
        for name in later:
            t = CHAIN[name](t)
        return t

    chain = beside_prose(chain, rules) if len(later) > 3 else rules(chain)
    out = with_computed(out, clean, F.expr(chain))
    if "punycode" in use:
        out = out.withColumn(clean, U.decode_punycode(F.col(clean)))
    return out.withColumn("was_modified", F.col(clean) != F.col(text))


def only(docs: DataFrame, *rules: str, text: str = "text", clean: str = "clean") -> DataFrame:
    """Apply just the named rules."""
    return refang(docs, text, clean, skip=[name for name in RULES if name not in rules])
