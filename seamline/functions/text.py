"""Text expressions: decoding, lines, line ranges, previews. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seamline.fixed_values import INDENT, PREVIEW_GAP

_NL = "\n"
_BAD = "�"
_MARK = "\x01"


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decode_utf8(content: Column) -> Column:
    """Bytes to text; bytes that are not UTF-8 are dropped, a true U+FFFD is kept.

    Spark marks bad bytes with U+FFFD, so genuine ones are escaped beforehand.
    """
    raw = content.cast("string")
    escaped = F.replace(
        F.replace(raw, F.lit(_MARK), F.lit(_MARK + "0")), F.lit(_BAD), F.lit(_MARK + "1")
    )
    kept = F.replace(F.make_valid_utf8(escaped), F.lit(_BAD), F.lit(""))
    restored = F.replace(
        F.replace(kept, F.lit(_MARK + "1"), F.lit(_BAD)), F.lit(_MARK + "0"), F.lit(_MARK)
    )
    return F.when(F.is_valid_utf8(raw), raw).otherwise(restored)


def unix_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit(_NL)), F.lit("\r"), F.lit(_NL))


def split_lines(text: Column) -> Column:
    """Lines without their newline; only `\\n` separates, a final one opens no line."""
    body = F.when(text.endswith(_NL), F.left(text, F.char_length(text) - 1)).otherwise(text)
    return F.when(F.char_length(text) > 0, F.split(body, _NL, -1)).otherwise(
        F.array().cast("array<string>")
    )


def count_lines(text: Column) -> Column:
    """Size of `split_lines` without building the array; 0 for null."""
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(_NL), F.lit("")))
    open_line = F.when((text == "") | text.endswith(_NL), 0).otherwise(1)
    return F.coalesce((newlines + open_line).cast("int"), F.lit(0))


def join_range(lines: Column, start: Column, end: Column, closed: Column) -> Column:
    """Lines start..end (1-based, inclusive) with their newlines.

    `closed` says whether the last line of the whole text ends in a newline.
    """
    n = F.size(lines)
    tail = F.when(start > n, "").when((end < n) | closed, _NL).otherwise("")
    return F.concat(F.array_join(F.slice(lines, start, end - start + 1), _NL), tail)


def line_range(text: Column, start: Column, end: Column) -> Column:
    """The stored range cut from the text as it is now; "" past its end."""
    return bind(
        split_lines(text), lambda lines: join_range(lines, start, end, text.endswith(_NL))
    )


def preview(content: Column, max_lines: int | None) -> Column:
    """Longer texts become first half, a gap marker, last half.

    For max_lines 0 and 1 the halves are empty and the marker precedes the
    whole text.
    """
    if max_lines is None:
        return content
    if max_lines < 0:
        raise ValueError("max_lines must not be negative")
    half = max_lines // 2
    gap = F.array(F.lit(PREVIEW_GAP))

    def shorten(lines):
        if half == 0:
            short = F.concat(gap, lines)
        else:
            short = F.concat(F.slice(lines, 1, half), gap, F.slice(lines, -half, half))
        return F.array_join(F.when(F.size(lines) > max_lines, short).otherwise(lines), _NL)

    return bind(F.split(content, _NL, -1), shorten)


def text_block(path: Column, start: Column, end: Column, score: Column, content: Column) -> Column:
    """Header, content indented by four, and an empty line."""
    header = F.format_string("%s:%d-%d  score=%.2f", path, start, end, score)
    indented = F.array_join(
        F.transform(F.split(content, _NL, -1), lambda line: F.concat(F.lit(INDENT), line)), _NL
    )
    return F.concat(header, F.lit(_NL), indented, F.lit(_NL))
