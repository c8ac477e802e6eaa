"""SQL (DuckDB dialect) twins of the column functions, for the oracles.

They restate the rules of ``functions.text`` as SQL text so that the
driver can recompute every registered query independently of Spark.
"""

from __future__ import annotations

from .. import schema as S

WS = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
WS_NO_LF = r"[\t\x{0b}-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
NON_WS = r"[^\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def py_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def collapse_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR NOT regexp_matches({x}, '{NON_WS}'))"


def clean_sms(x: str) -> str:
    return f"nullif({collapse_ws(x)}, '')"


def clean_mail_body(x: str) -> str:
    t = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '(?m)^{WS_NO_LF}+|{WS_NO_LF}+$', '', 'g')"
    return f"nullif({py_strip(t)}, '')"


def strip_residual_headers(x: str) -> str:
    pat = "(?im)" + "|".join(f"^{h}:.*$" for h in S.RESIDUAL_HEADERS)
    return f"regexp_replace({x}, {q(pat)}, '', 'g')"


def clean_mail_text(x: str) -> str:
    return f"CASE WHEN NOT {is_blank(x)} THEN {clean_mail_body(strip_residual_headers(x))} END"


def contains_any(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(w)})" for w in words) + ")"


def first_tactic(x: str, ordered, default: str) -> str:
    low = f"lower({x})"
    whens = " ".join(f"WHEN coalesce({contains_any(low, ws)}, false) THEN {q(n)}" for n, ws in ordered)
    return f"CASE {whens} ELSE {q(default)} END"


def tactic_sms(x: str) -> str:
    return first_tactic(x, S.SMS_TACTICS, S.SMS_TACTIC_DEFAULT)


def tactic_mail(x: str) -> str:
    return first_tactic(x, [(t, S.MAIL_TACTIC_KEYWORDS[t]) for t in S.MAIL_TACTIC_ORDER], S.MAIL_TACTIC_DEFAULT)


def normalize_address(x: str) -> str:
    return f"coalesce({py_strip(f'lower({x})')}, '')"


def anonymize_address(x: str) -> str:
    dom = rf"regexp_extract({x}, '@([\p{{L}}\p{{N}}_.-]+)', 1)"
    return f"CASE WHEN NOT {is_blank(x)} AND {dom} <> '' THEN 'user@' || {dom} ELSE 'unknown' END"


def parse_timestamp_utc(x: str) -> str:
    t = py_strip(x)
    t = f"regexp_replace({t}, '^[A-Za-z]{{3}},{WS}*', '')"
    t = f"regexp_replace({t}, '{WS}*\\([^)]*\\){WS}*$', '')"
    t = f"regexp_replace({t}, '{WS}+', ' ', 'g')"
    fmts = ["%d %b %Y %H:%M:%S %z", "%d %b %Y %H:%M %z", "%d %b %Y %H:%M:%S", "%Y-%m-%d %H:%M:%S%z",
            "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d"]
    return f"try_strptime({t}, [{', '.join(q(f) for f in fmts)}])"


def ts_text(x: str) -> str:
    """Timestamp -> 'yyyy-MM-dd HH:mm:ss' (UTC)."""
    return f"strftime(CAST({x} AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"


def has_url(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '(?i)(https?://|www\\.)'), false)"


SEP = r"[-.\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
PHONE = rf"(\+?\p{{Nd}}{{1,3}}{SEP}?)?\(?\p{{Nd}}{{2,4}}\)?{SEP}?\p{{Nd}}{{3,4}}{SEP}?\p{{Nd}}{{3,4}}"


def has_phone(x: str) -> str:
    return f"coalesce(regexp_matches({x}, {q(PHONE)}), false)"


def has_authority(x: str) -> str:
    return f"coalesce({contains_any(f'lower({x})', S.AUTHORITY_KEYWORDS)}, false)"


def has_urgency(x: str) -> str:
    return f"coalesce({contains_any(f'lower({x})', S.URGENCY_KEYWORDS)}, false)"


def stable_id(*parts: str) -> str:
    cols = ", ".join(f"coalesce(CAST({p} AS VARCHAR), chr(0))" for p in parts)
    return f"md5(concat_ws(chr(31), {cols}))"


def stdlib_body_text(x: str) -> str:
    """What the standard mail parser returns for a plain body without a
    charset: ASCII kept, U+0080..U+00FF -> U+FFFD, others escaped."""
    return (f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE "
            f"WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 256 THEN chr(65533) "
            f"WHEN unicode(c) < 65536 THEN printf('\\u%04x', unicode(c)) "
            f"ELSE printf('\\U%08x', unicode(c)) END), '')")


def preview(x: str, n: int = 200, ellipsis: bool = True, flatten: bool = False) -> str:
    p = f"substring({x}, 1, {n})"
    if flatten:
        p = py_strip(f"replace({p}, chr(10), ' ')")
    if ellipsis:
        p = f"CASE WHEN length({x}) > {n} THEN {p} || '...' ELSE {p} END"
    return p


def sanitize(x: str) -> str:
    return f"substring(replace(coalesce(CAST({x} AS VARCHAR), ''), chr(0), ''), 1, {S.MAX_CHAR_LENGTH})"


def preprocess(x: str, cut: bool = True) -> str:
    return collapse_ws(sanitize(x) if cut else f"replace(coalesce({x}, ''), chr(0), '')")
