"""Encoded and multi-part mail as column expressions.

Covers mail in ASCII whose text is base64 or quoted-printable in UTF-8 or ASCII,
or whose text is the first text/plain part of any nesting of parts; header lines
may be folded. Parts are found by one fold over the lines: the state holds the
stack of open boundaries, the header lines of the current part, and where the
wanted part begins and ends; no text is copied in it. Whatever a decoder would
have to repair is not covered (``covered`` is false) and left to the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# phases of the fold
SKIP, HEADERS, WANTED, DONE = 0, 1, 2, 3

STATE = "struct<stack: array<string>, phase: int, head: string, first: int, stop: int, coding: string, charset: string, bad: boolean>"


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header ``name:`` in unfolded, LF-separated headers; '' if missing."""
    return F.regexp_extract(headers, rf"(?imd)^{name}:[ \t]*(.*?)[ \t]*$", 1)


def unfold(headers: Column) -> Column:
    return F.regexp_replace(headers, r"\n(?=[ \t])", "")


def media_type(value: Column) -> Column:
    return F.lower(F.regexp_extract(value, r"^([!#$&^_.+A-Za-z0-9-]+/[!#$&^_.+A-Za-z0-9-]+)[ \t]*(?:;|$)", 1))


def parameter(value: Column, name: str) -> Column:
    """A parameter of a header value, quoted or bare; '' if missing."""
    quoted = F.regexp_extract(value, rf'(?i);[ \t]*{name}="([^"\\]*)"', 1)
    bare = F.regexp_extract(value, rf"(?i);[ \t]*{name}=([^\s;\"]+)", 1)
    return F.when(quoted != "", quoted).otherwise(bare)


def _once(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decoded(text: Column, coding: Column, charset: Column, eol: Column) -> Column:
    """The text of a part, its own line ends written as ``eol``, or null if it is not covered."""
    ascii_only = F.lower(charset).isin("", "us-ascii", "ascii")
    known = ascii_only | F.lower(charset).isin("utf-8", "utf8")
    compact = F.regexp_replace(text, r"[ \t\n]", "")
    whole = compact.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    from_base64 = F.when(whole, F.unbase64(F.when(whole, compact).otherwise(F.lit(""))).cast("string"))
    escapes = ~text.rlike(r"[ \t](?:\n|$)") & ~F.regexp_replace(text, r"=(?:[0-9A-F]{2}|\n)", "").contains("=")
    joined = F.replace(F.replace(text, F.lit("=\n"), F.lit("")), F.lit("\n"), eol)
    for a, b in (("%", "%25"), ("+", "%2B"), ("=", "%")):
        joined = F.replace(joined, F.lit(a), F.lit(b))
    from_quoted = F.when(escapes, F.try_url_decode(joined))
    low = F.lower(coding)
    value = F.when(low.isin("", "7bit", "8bit"), F.replace(text, F.lit("\n"), eol)).when(low == "base64", from_base64).when(low == "quoted-printable", from_quoted)
    return _once(value, lambda v: F.when(known & F.is_valid_utf8(v) & ~v.contains("�") & ~(ascii_only & v.rlike(r"[^\x{00}-\x{7f}]")), v))


def _walk(lines: Column, boundary: Column) -> Column:
    """The fold: state after all lines of a multi-part body."""
    start = F.struct(F.array(boundary).alias("stack"), F.lit(SKIP).alias("phase"), F.lit("").alias("head"), F.lit(-1).alias("first"),
                     F.lit(-1).alias("stop"), F.lit("").alias("coding"), F.lit("").alias("charset"), F.lit(False).alias("bad")).cast(STATE)

    def state(s, **new):
        fields = ("stack", "phase", "head", "first", "stop", "coding", "charset", "bad")
        return F.struct(*[new.get(f, s[f]).alias(f) for f in fields]).cast(STATE)

    def at_boundary(s, at, depth, opens):
        stack = F.slice(s["stack"], 1, F.when(opens, depth).otherwise(depth - 1).cast("int"))
        inside = s["phase"] == WANTED
        return state(s, stack=stack, head=F.lit(""), stop=F.when(inside, at).otherwise(s["stop"]),
                     phase=F.when(inside, F.lit(DONE)).when(opens, F.lit(HEADERS)).otherwise(F.lit(SKIP)),
                     bad=s["bad"] | (s["phase"] == HEADERS))                       # a part without its blank line

    def part_begins(s, at):
        head = unfold(s["head"])
        kind_line = header_value(head, "content-type")
        kind = F.when(kind_line == "", F.lit("text/plain")).otherwise(media_type(kind_line))
        mark = parameter(kind_line, "boundary")
        many = kind.startswith("multipart/")
        return state(s, head=F.lit(""), first=F.when(kind == "text/plain", at + 1).otherwise(s["first"]),
                     phase=F.when(kind == "text/plain", F.lit(WANTED)).otherwise(F.lit(SKIP)),
                     stack=F.when(many, F.concat(s["stack"], F.array(mark))).otherwise(s["stack"]),
                     coding=F.when(kind == "text/plain", header_value(head, "content-transfer-encoding")).otherwise(s["coding"]),
                     charset=F.when(kind == "text/plain", parameter(kind_line, "charset")).otherwise(s["charset"]),
                     bad=s["bad"] | (kind == "") | kind.startswith("message/") | (kind == "multipart/digest") | (many & (mark == "")))

    def step(s, x):
        line, at = x["line"], x["at"]
        name = F.regexp_replace(F.substring(line, 3, 1 << 20), r"[ \t]+$", "")
        opened = F.array_position(s["stack"], name)
        closed = F.when(name.endswith("--"), F.array_position(s["stack"], F.regexp_replace(name, "--$", ""))).otherwise(F.lit(0))
        header_line = line.rlike(r"^[!-9;-~]+:") | ((s["head"] != "") & line.rlike(r"^[ \t]"))
        return (F.when((s["phase"] == DONE) | s["bad"], s)
                .when(line.startswith("--") & (opened > 0), at_boundary(s, at, opened, F.lit(True)))
                .when(line.startswith("--") & (closed > 0), at_boundary(s, at, closed, F.lit(False)))
                .when((s["phase"] == HEADERS) & (line == ""), part_begins(s, at))
                .when(s["phase"] == HEADERS, state(s, head=F.concat(s["head"], line, F.lit("\n")), bad=~header_line))
                .otherwise(s))

    numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("at")))
    return F.aggregate(numbered, start, step)


def text_of(headers: Column, body: Column, eol: Column) -> Column:
    """The text of a mail from its unfolded headers and its LF-separated body, or null if it is not covered;
    ``eol``: the line end that the mail had."""
    kind_line = header_value(headers, "content-type")
    kind = F.when(kind_line == "", F.lit("text/plain")).otherwise(media_type(kind_line))
    boundary = parameter(kind_line, "boundary")

    def part(lines):
        return _once(_walk(lines, boundary), lambda s: F.when((s["phase"] == DONE) & ~s["bad"], decoded(
            F.array_join(F.slice(lines, s["first"] + 1, F.greatest(s["stop"] - s["first"], F.lit(0))), "\n"), s["coding"], s["charset"], eol)))

    single = decoded(body, header_value(headers, "content-transfer-encoding"), parameter(kind_line, "charset"), eol)
    return F.when(kind == "text/plain", single).when(
        kind.startswith("multipart/") & (kind != "multipart/digest") & (boundary != ""), _once(F.split(body, "\n", -1), part))
