"""Column functions on text, ids, sizes and budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tree

#: What Unicode takes for white space, with the ASCII separators that Java's class leaves out.
UNICODE_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}\z"


def structural_text(text: Column) -> Column:
    """Line breaks go with the blanks and tabs around them, then tabs; inner spaces stay."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]*[\r\n]+[ \t]*", ""), r"\t", "")


def stripped(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, UNICODE_SPACE + "+", "")


def nonspace_count(text: Column) -> Column:
    return F.length(stripped(text))


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(ID_PATTERN), F.lit(False))


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def control_markup(text: Column) -> Column:
    """Chat control tokens, thought or tool tags, or code fences."""
    return text.rlike(r"<\|[^|]*\|>|</?(?:think|tool_call|tool_response)\b|```|~~~")


def code_markup(xml: Column) -> Column:
    return xml.rlike(r"<(?:\w+:)?(?:pre|code)[\s/>]")


def safe_link(url: Column) -> Column:
    """http or https with a host and without user information."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#@\s]+(?:[/?#]\S*)?$"), F.lit(False))


def service_url(url: Column, debug: bool = False) -> Column:
    """The address without its last slashes; null where it has user information, a query or a fragment."""
    scheme = "https?" if debug else "https"
    bare = F.trim(url)
    return F.when(bare.rlike(rf"(?i)^{scheme}://[^/?#@\s]+(?:/[^?#\s]*)?$"), F.regexp_replace(bare, "/+$", ""))


def transient_error(name: Column, status: Column) -> Column:
    """Errors worth another try: time-outs and connection faults by name, 408, 429 and 500 on."""
    by_name = name.isin("TimeoutError", "ConnectionError", "ConnectionResetError", "ConnectionRefusedError", "RemoteDisconnected", "IncompleteRead")
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(status.isin(408, 429) | (status >= 500), F.lit(False))


def image_tokens(t: Column, h: Column, w: Column, merge: int) -> Column:
    """t * h * w / merge²; an error unless the merge divides both sides."""
    fits = ((h % merge) == 0) & ((w % merge) == 0) & (t > 0) & (h > 0) & (w > 0)
    return F.when(fits, (t * h * w / (merge * merge)).cast("long")).otherwise(F.raise_error(F.lit("grid isn't divisible by the merge size")).cast("long"))


def output_budget(prompt: Column, most: int = 8192, context: int = 16384, reserve: int = 512) -> Column:
    """Tokens left for output; the request fits if there are ``reserve`` at least."""
    return F.least(F.lit(most), F.lit(context - reserve) - prompt)


def context_fits(prompt: Column, output: Column, context: Column) -> Column:
    return prompt + output <= context


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def target_size(width: Column, height: Column, edge: int) -> tuple[Column, Column]:
    """Width and height with the longer one at most ``edge``, aspect kept, never enlarged."""
    longest = F.greatest(width, height)
    scale = F.lit(float(edge)) / longest

    def fit(x: Column) -> Column:
        return F.when(longest <= edge, x.cast("long")).otherwise(F.greatest(F.lit(1), half_up(x * scale)).cast("long"))

    return fit(width), fit(height)


def sample_size(width: Column, height: Column, edge: int) -> Column:
    """The largest power of two by which the longer side can shrink and stay at least ``edge``."""
    ratio = F.greatest(width, height) / F.lit(float(edge))
    return F.when(ratio < 2, F.lit(1)).otherwise(F.pow(F.lit(2), F.floor(F.log2(ratio)))).cast("long")


def advanced_state(now: Column, new: Column, order: list[str], terminal: list[str]) -> Column:
    """The later of two states; one that ends stays."""
    rank = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))])
    return F.when(now.isin(*terminal) | (F.coalesce(rank[new], F.lit(-1)) < rank[now]), now).otherwise(new)


def fence(text: Column) -> Column:
    """A code fence longer than any run of backticks in the text, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def escaped(text: Column) -> Column:
    """HTML or XML escapes of the five signs."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def backoff_seconds(failures: Column, most: int = 30) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(2), failures)).cast("long")


def data_url(content: Column, path: Column) -> Column:
    """PNG or JPEG bytes as a data address; null for other files."""
    kind = F.when(F.lower(path).endswith(".png"), "image/png").when(F.lower(path).rlike(r"\.jpe?g$"), "image/jpeg")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def last_capacity(log: Column) -> Column:
    """The last reported cache size of a log, in tokens; null if there is none."""
    found = F.regexp_extract_all(log, F.lit(r"KV cache size:\s*([0-9,]+) tokens"), F.lit(1))
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")).cast("long")


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def iso_time(ts: Column) -> Column:
    """ISO 8601 with microseconds, in the session's time zone, which is taken for UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def paragraph(text: Column) -> Column:
    """A paragraph of plain text, lines parted by br."""
    return F.concat(F.lit("<p>"), F.replace(escaped(text), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))


def update(blocks: Column, kind: str = "update") -> Column:
    """Blocks in their envelope."""
    start, _, end = tree.envelope("\0", kind).partition("\0")
    return F.concat(F.lit(start), blocks, F.lit(end))


def unsigned(content: Column, start: int, size: int) -> Column:
    """A big-endian number in binary content; the first byte has the place 1."""
    return F.conv(F.hex(F.substring(content, start, size)), 16, 10).cast("long")


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height in the head of a PNG file; null for others."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.when(png, unsigned(content, 17, 4)), F.when(png, unsigned(content, 21, 4))


def oriented(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Sizes as an image is shown: orientations from 5 on lie on their side."""
    turned = F.coalesce(orientation >= 5, F.lit(False))
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def half_window(text: Column, start: Column, end: Column) -> Column:
    """Half of a window of characters, back to the line end before it if there is one."""
    middle = start + F.floor((end - start) / 2)
    head = F.substr(text, (start + 1).cast("int"), (middle - start + 1).cast("int"))
    lines = F.length(F.substring_index(head, "\n", -1))
    return F.when(F.contains(head, F.lit("\n")), start + F.length(head) - lines).otherwise(middle)
