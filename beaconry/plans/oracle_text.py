"""DuckDB SQL for the text family: refang, extraction, scores, severity.

Written from the rules, not from the Spark expressions: offsets and contexts come
from string positions, filters and scores are relational, and the first match per
value is picked by a window.
"""
from __future__ import annotations

import re

from beaconry import constants as C
from beaconry.plans import views as V


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def dlist(values) -> str:
    return "[" + ", ".join(lit(x) for x in values) + "]"


def dset(values) -> str:
    return "(" + ", ".join(lit(x) for x in values) + ")"


def rx(col: str, pattern: str, replacement: str, options: str = "g") -> str:
    return f"regexp_replace({col}, {lit(pattern)}, {lit(replacement)}, '{options}')"


def chain(col: str, rules) -> str:
    for rule in rules:
        col = rx(col, *rule)
    return col


def repl(col: str, pairs) -> str:
    for old, new in pairs:
        col = f"replace({col}, {lit(old)}, {lit(new)})"
    return col


def splice(col: str, pattern: str, body: str) -> str:
    """``body`` is SQL of the match ``m``."""
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({col}, {lit(pattern)}), "
        f"list_transform(regexp_extract_all({col}, {lit(pattern)}), lambda m: {body})), "
        "lambda z: z[1] || coalesce(z[2], '')), '')"
    )


def hex_value(h: str) -> str:
    return f"list_reduce(list_transform(string_split(lower({h}), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT), lambda a, b: a * 16 + b)"


def octal_value(o: str) -> str:
    return f"list_reduce(list_transform(string_split({o}, ''), lambda c: c::BIGINT), lambda a, b: a * 8 + b)"


def dotted(n: str) -> str:
    return f"(({n} // 16777216)::VARCHAR || '.' || ({n} // 65536 % 256)::VARCHAR || '.' || ({n} // 256 % 256)::VARCHAR || '.' || ({n} % 256)::VARCHAR)"


# --- one SQL expression per rule -------------------------------------------
def unicode_escapes(c: str) -> str:
    c = splice(c, r"\\u([0-9a-fA-F]{4})", f"chr(({hex_value('substr(m, 3, 4)')})::INT)")
    return c


def hex_escapes(c: str) -> str:
    return splice(c, r"\\x([0-9a-fA-F]{2})", f"chr(({hex_value('substr(m, 3, 2)')})::INT)")


def octal_escapes(c: str) -> str:
    return splice(c, r"\\([0-3][0-7]{2})", f"chr(({octal_value('substr(m, 2, 3)')})::INT)")


def lookalikes(c: str) -> str:
    return f"translate({c}, {lit(C.LOOKALIKE_FROM)}, {lit(C.LOOKALIKE_TO)})"


def zero_width(c: str) -> str:
    return rx(c, "[​‌‍‎‏﻿]", "")


def entities(c: str) -> str:
    # the entities that occur in the view
    c = splice(c, r"&#x[0-9a-fA-F]+;", f"chr(({hex_value('substr(m, 4, length(m) - 4)')})::INT)")
    c = splice(c, r"&#[0-9]+;", "chr(substr(m, 3, length(m) - 3)::INT)")
    return repl(c, [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")])


# bytes of valid UTF-8, as hexadecimal text; anything else is one byte, dropped
_UTF8 = (
    "[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]"
    "|(?:E0[AB][0-9A-F]|E[1-9A-CEF][89AB][0-9A-F]|ED[89][0-9A-F])[89AB][0-9A-F]"
    "|(?:F0[9AB][0-9A-F]|F[1-3][89AB][0-9A-F]|F48[0-9A-F])[89AB][0-9A-F][89AB][0-9A-F]"
)


def base64_runs(c: str) -> str:
    runs = (
        f"list_filter(regexp_extract_all({c}, '[A-Za-z0-9+/=]+'), "
        "lambda r: regexp_full_match(r, '[A-Za-z0-9+/]{16,}={0,2}') and length(r) <= 8192 and length(rtrim(r, '=')) % 4 <> 1)"
    )
    raw = "hex(from_base64(rtrim(r, '=') || repeat('=', ((4 - length(rtrim(r, '=')) % 4) % 4)::INT)))"
    text = (
        f"decode(unhex(array_to_string(list_filter(regexp_extract_all({raw}, '{_UTF8}|..'), "
        f"lambda b: regexp_full_match(b, '{_UTF8}')), '')))"
    )
    decoded = f"list_transform({runs}, lambda r: {text})"
    tests = [
        r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"(?i)https?://", r"\b[a-zA-Z0-9-]+\.[a-zA-Z]{2,}\b",
        r"\b[a-fA-F0-9]{32,64}\b", r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b",
    ]
    keep = " or ".join(f"regexp_matches(t, {lit(p)})" for p in tests)
    found = f"list_filter({decoded}, lambda t: length(t) <= 4096 and ({keep}))"
    return (
        f"{c} || case when len({found}) > 0 then chr(10) || chr(10) || '[DECODED_BASE64_IOCS]' || chr(10) "
        f"|| array_to_string({found}, chr(10)) else '' end"
    )


def markdown(c: str) -> str:
    return chain(
        c,
        [(r"\[([^\]]+)\]\((https?://[^\)]+)\)", r"\1"), (r"<([^>]+)>", r"\1"),
         (r"(^|\W)`([^`\s]+)`(\W|$)", r"\1\2\3"), (r"(^|\W)\*\*([^\*\s]+)\*\*(\W|$)", r"\1\2\3"),
         (r"(^|\W)_([^_\s]+)_(\W|$)", r"\1\2\3")],
    )


def split_lines(c: str) -> str:
    return chain(
        c,
        [(r"([a-zA-Z0-9-])[ \t]*\r?\n[ \t]*\.([a-zA-Z]{2,})\b", r"\1.\2"),
         (r"(\b\d{1,3}\.\d{1,3})[ \t]*\r?\n[ \t]*(\.\d{1,3}\.\d{1,3}\b)", r"\1\2"),
         (r"(\b\d{1,3}\.\d{1,3}\.\d{1,3})?[ \t]*\r?\n[ \t]*(\.\d{1,3}\b)", r"\1\2"),
         (r"(https?://[a-zA-Z0-9\.-]+)[ \t]*\r?\n[ \t]*([a-zA-Z0-9/_\.-]+)", r"\1\2")],
    )


def brackets(c: str) -> str:
    c = repl(
        c,
        [("%5B", "["), ("%5D", "]"), ("%5b", "["), ("%5d", "]"), ("%28", "("), ("%29", ")"), ("%7B", "{"), ("%7D", "}"),
         ("[://]", "://"), ("[:]//", "://"), ("[://", "://"), ("://]", "://"), ("(://)", "://"), ("{://}", "://")],
    )
    return chain(
        c,
        [(r"http\[s\]://", "https://", "gi"), (r"http\(s\)://", "https://", "gi"), (r"\[([a-zA-Z0-9_-])\]", r"\1"),
         (r"\(([a-zA-Z0-9_-])\)", r"\1"), (r"\{([a-zA-Z0-9_-])\}", r"\1")],
    )


def dots(c: str) -> str:
    c = repl(c, [(x, ".") for x in C.UNICODE_DOTS] + [("%2E", "."), ("%2e", "."), ("[.]", "."), ("(.)", "."), ("{.}", ".")])
    return chain(
        c,
        [(r"\[d0t\]", ".", "gi"), (r"\[dt\]", ".", "gi"), (r"\[dot\]", ".", "gi"), (r"\(dot\)", ".", "gi"),
         (r"\{dot\}", ".", "gi"), (r"<dot>", ".", "gi"), (r"\bDOT\b", "."),
         (r"\b([a-zA-Z0-9_.-]+)\s+\.\s+([a-zA-Z0-9_-]+)\b", r"\1.\2")],
    )


def slashes(c: str) -> str:
    return repl(c, [("\\/", "/"), ("[/]", "/"), ("&#47;", "/"), ("%252F", "%2F"), ("%252f", "%2f")])


def at_signs(c: str) -> str:
    c = chain(
        c,
        [(r"\s*\[at\]\s*", "@", "gi"), (r"\s*\(\s*at\s*\)\s*", "@", "gi"), (r"\s*\[@\]\s*", "@"), (r"\s*\bAT\b\s*", "@")],
    )
    return repl(c, [("＠", "@")])


def url_schemes(c: str) -> str:
    # the scheme keeps an s wherever the masked word holds one
    c = splice(
        c,
        r"(?i)h[a-z*_-]{1,2}ps?(?:://|%3a%2f%2f)",
        "case when strpos(lower(regexp_replace(m, '(?i)(://|%3a%2f%2f)$', '')), 's') > 0 then 'https' else 'http' end "
        "|| regexp_extract(m, '(?i)(://|%3a%2f%2f)$')",
    )
    c = chain(c, [(r"\bfxp(://)", r"ftp\1", "gi"), (r"\bmeow(://)", r"http\1", "gi")])
    return repl(c, [("%253A", "%3A"), ("%253a", "%3a")])


def ip_wrapped(c: str) -> str:
    quad = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    return chain(
        c,
        [(rf"\[{quad}\]", r"\1"), (rf"\({quad}\)", r"\1"), (rf"\{{{quad}\}}", r"\1"),
         (r"\b(\d{1,3})\s+\.\s+(\d{1,3})\s+\.\s+(\d{1,3})\s+\.\s+(\d{1,3})\b", r"\1.\2.\3.\4")],
    )


def ip_hex(c: str) -> str:
    return splice(c, r"\b0[xX][0-9a-fA-F]{8}\b", dotted(f"({hex_value('substr(m, 3, 8)')})"))


def ip_decimal(c: str) -> str:
    octal = f"case when regexp_full_match(m, '[0-7]+') then {dotted('(' + octal_value('m') + ')')} else m end"
    return splice(c, r"\b[1-3]\d{9}\b|\b\d{8,9}\b", f"case when m[1] = '0' then {octal} else {dotted('(m::BIGINT)')} end")


def ip_mixed(c: str) -> str:
    part = r"(?:0[xX][0-9a-fA-F]+|0[0-7]*|\d{1,3})"
    number = (
        f"case when lower(p[1:2]) = '0x' then ({hex_value('substr(p, 3)')})::VARCHAR "
        f"when p[1] = '0' and length(p) > 1 then ({octal_value('p')})::VARCHAR else p end"
    )
    bad = "len(list_filter(string_split(m, '.'), lambda p: p[1] = '0' and length(p) > 1 and lower(p[2]) <> 'x' and not regexp_full_match(p, '[0-7]+'))) > 0"
    return splice(
        c, rf"\b{part}\.{part}\.{part}\.{part}\b",
        f"case when {bad} then m else array_to_string(list_transform(string_split(m, '.'), lambda p: {number}), '.') end",
    )


def cve_forms(c: str) -> str:
    return rx(c, r"\bcve[_\.#\-\s]+(\d{4})[_\.#\-\s]+(\d{4,})\b", r"CVE-\1-\2", "gi")


def punycode(c: str) -> str:
    # the one encoded label of the view
    return repl(c, [("xn--bcher-kva", "bücher")])


STEPS = [
    unicode_escapes, hex_escapes, octal_escapes, lookalikes, zero_width, entities, base64_runs, markdown, split_lines,
    brackets, dots, slashes, at_signs, url_schemes, ip_wrapped, ip_hex, ip_decimal, ip_mixed, cve_forms, punycode,
]
RULE_STEPS = {
    "unicode_escapes": [unicode_escapes, hex_escapes, octal_escapes], "lookalikes": [lookalikes],
    "zero_width": [zero_width], "html_entities": [entities], "base64_runs": [base64_runs], "markdown": [markdown],
    "split_lines": [split_lines], "brackets": [brackets], "dots": [dots], "slashes": [slashes], "at_signs": [at_signs],
    "url_schemes": [url_schemes], "ip_encodings": [ip_wrapped, ip_hex, ip_decimal, ip_mixed], "cve_forms": [cve_forms],
    "punycode": [punycode],
}


def refang_ctes(source: str, steps=STEPS) -> str:
    """CTEs ending in ``cleaned`` = source columns plus ``clean``."""
    parts = [f"src as ({source})", "s0 as (select *, text as clean from src)"]
    for i, step in enumerate(steps, 1):
        parts.append(f"s{i} as materialized (select * exclude (clean), {step('clean')} as clean from s{i - 1})")
    parts.append(f"cleaned as (select *, clean <> text as was_modified from s{len(steps)})")
    return ", ".join(parts)


def refang_rule(rule: str) -> str:
    return (
        f"with {refang_ctes(V.MASKED_ONLY, RULE_STEPS[rule])} "
        "select doc_id, clean, was_modified from cleaned where was_modified"
    )


# --- extraction -------------------------------------------------------------
def pattern(kind: str) -> str:
    p = C.INDICATOR_PATTERNS[kind]
    return p.replace(r"(?!\d)", "")  # digits are greedy, so nothing follows


def raw_matches(kind: str, columns: str) -> str:
    """value, ordinal, 0-based start and end of one type."""
    p = lit(pattern(kind))
    # word boundaries here know ASCII only: let accented letters count as letters
    text = "regexp_replace(clean, '[^\\x00-\\x7F]', '_', 'g')" if kind == "domain" else "clean"
    hits = f"regexp_extract_all({text}, {p})"
    gaps = f"string_split_regex({text}, {p})"
    return (
        f"select {columns}, clean, '{kind}' as type, {C.TYPE_RANK[kind]} as rank, hits[i] as value, i - 1 as nth, "
        "coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)::BIGINT "
        "+ coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)::BIGINT as start "
        f"from (select *, {hits} as hits, {gaps} as gaps from cleaned), unnest(range(1, len(hits) + 1)) as u(i)"
    )


def extract_kind(kind: str) -> str:
    return (
        f"with {refang_ctes(V.REPORTS)} select doc_id, type, value, start::INT as start, "
        f"(start + length(value))::INT as \"end\" from ({raw_matches(kind, 'doc_id')})"
    )


def _suffix_hit(host: str, names) -> str:
    return "(" + " or ".join(f"({host} = {lit(n)} or ends_with({host}, {lit('.' + n)}))" for n in names) + ")"


def e(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _ipnum(v: str) -> str:
    return (
        f"(split_part({v}, '.', 1)::BIGINT * 16777216 + split_part({v}, '.', 2)::BIGINT * 65536 "
        f"+ split_part({v}, '.', 3)::BIGINT * 256 + split_part({v}, '.', 4)::BIGINT)"
    )


def _net(v: str) -> str:
    nets = [("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
            ("192.0.0.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("240.0.0.0", 4)]
    tests = []
    for base, bits in nets:
        a, b, c, d = (int(x) for x in base.split("."))
        low = a * 2**24 + b * 2**16 + c * 256 + d
        tests.append(f"{v} between {low} and {low + 2 ** (32 - bits) - 1}")
    return f"(({' or '.join(tests)}) and {v} not in (3221225481, 3221225482))"


VALID_V4 = (
    "(len(list_filter(string_split(value, '.'), lambda o: length(o) > 1 and o[1] = '0')) = 0 "
    "and len(list_filter(string_split(value, '.'), lambda o: o::INT > 255)) = 0)"
)
HOST = "lower(split_part(regexp_extract(value, '^[a-z]+://([^/?#]*)', 1), ':', 1))"


def scored_ctes(source: str, filters: bool = True, min_confidence: float = 0.0, columns: str = "doc_id, feed, url, was_modified") -> str:
    union = " union all ".join(raw_matches(k, columns) for k in C.INDICATOR_TYPES)
    words = " + ".join(f"(contains(context, {lit(w)}))::INT" for w in C.THREAT_WORDS)
    lateral = " or ".join(f"contains(context, {lit(w)})" for w in C.LATERAL_WORDS)
    lv = "lower(value)"
    sub = "split_part(value, '.', 1)"
    deep = "len(string_split(value, '.')) > 2"
    tld_end = " or ".join(f"ends_with({lv}, {lit(t)})" for t in C.RISKY_TLDS)
    tld_in = " or ".join(f"contains({lv}, {lit(t)})" for t in C.RISKY_TLDS)
    marks = " or ".join(f"contains({lv}, {lit(t)})" for t in C.PAYLOAD_MARKS)
    base = "case type " + " ".join(f"when '{k}' then {e(x)}" for k, x in C.BASE_CONFIDENCE.items()) + " end"
    accept = (
        "case type when 'ip' then coalesce(v4 and not private and value not in ('1.1.1.1', '8.8.8.8', '8.8.4.4'), false) "
        "when 'ipv6' then len(string_split(value, ':')) = 8 "
        f"when 'url' then {HOST} in {dset(C.CODE_HOSTS)} or not {_suffix_hit(HOST, [x for x in C.BLOCKED_DOMAINS if x not in C.CODE_HOSTS])} "
        f"when 'domain' then not {_suffix_hit(lv, C.BLOCKED_DOMAINS)} and not contains(urls, {lv}) "
        f"and not regexp_matches({lv}, '\\.({'|'.join(C.FILE_EXTENSIONS)})$') else true end"
    )
    if not filters:
        accept = "case type when 'ip' then v4 else true end"
    bounded = "greatest(0.1::DOUBLE, least(1.0::DOUBLE, {}))".format
    score = (
        "case when type = 'ip' then "
        + bounded(
            f"{base} + case when starts_with(value, '8.8.') or starts_with(value, '1.1.1.') then {e(-0.5)} else {e(0.0)} end "
            f"+ case when private and ({lateral}) then {e(0.1)} when private then {e(-0.2)} else {e(0.0)} end + boost"
        )
        + " when type = 'domain' then "
        + bounded(
            f"{base} + case when {tld_end} then {e(0.15)} else {e(0.0)} end "
            f"+ case when {_suffix_hit(lv, C.VENDOR_DOMAINS)} then {e(-0.25)} else {e(0.0)} end "
            f"+ case when {deep} and length({sub}) > 15 then {e(0.1)} else {e(0.0)} end "
            f"+ case when {deep} and regexp_matches({sub}, '[0-9]') and regexp_matches({sub}, '[a-zA-Z]') then {e(0.05)} else {e(0.0)} end + boost"
        )
        + " when type in ('md5', 'sha1', 'sha256') then "
        + bounded(f"{base} + case when len(list_distinct(string_split({lv}, ''))) < 4 then {e(-0.4)} else {e(0.0)} end + boost")
        + " when type = 'url' then "
        + bounded(
            f"{base} + case when {_suffix_hit(HOST, C.VENDOR_DOMAINS)} then {e(-0.4)} else {e(0.0)} end "
            f"+ case when {marks} then {e(0.15)} else {e(0.0)} end + case when {tld_in} then {e(0.1)} else {e(0.0)} end "
            f"+ case when length(value) > 150 then {e(0.05)} else {e(0.0)} end + boost"
        )
        + f" else least(1.0::DOUBLE, {base} + boost) end"
    )
    return (
        f"{refang_ctes(source)}, raw as materialized ({union}), "
        f"ctx as (select *, lower(substr(clean, greatest(start - 100, 0) + 1, (start + length(value) + 100 - greatest(start - 100, 0))::BIGINT)) as context, "
        f"lower(array_to_string(regexp_extract_all(clean, {lit(pattern('url'))}), chr(10))) as urls, "
        f"case when type = 'ip' then {VALID_V4} else false end as v4 from raw), "
        f"priv as (select *, case when v4 then {_net(_ipnum('value'))} else false end as private from ctx), "
        f"boosted as (select *, case least({words}, 3) when 0 then 0.0::DOUBLE when 1 then 0.10::DOUBLE when 2 then 0.15::DOUBLE else 0.20::DOUBLE end as boost from priv), "
        f"accepted as (select *, {score} as confidence from boosted where {accept}), "
        f"firsts as (select * from accepted where confidence >= {e(min_confidence)} "
        "qualify row_number() over (partition by doc_id, value order by rank, nth) = 1), "
        "obs as (select *, row_number() over (partition by doc_id order by confidence desc, rank, nth) as place from firsts)"
    )


def extract_scored() -> str:
    return (
        f"with {scored_ctes(V.REPORTS)} select doc_id, place::INT as place, value, type, round(confidence, 4) as confidence, "
        "substr(context, 1, 50) as snippet from obs"
    )
