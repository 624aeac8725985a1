"""Text as Columns: normal forms, clipping, escaping, redaction and path rules. JVM expressions but for Unicode normal
forms, which Spark lacks."""

from __future__ import annotations

import posixpath
import unicodedata
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Invisible and bidirectional characters that are dropped from extracted text.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}]"
# Unicode white space, and the separators that end a line.
SPACE = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"
# A scheme's name, looked for once in each run of the characters that it may have, so that time is linear in the text: what of
# the run comes before the first letter that begins a word (group 1), then all that follows (group 2).
SCHEME = r"(?<![a-z0-9+.-])((?:(?<=\w)[a-z0-9]*+|[0-9][a-z0-9]*+)?+(?:[+.-]++(?:[0-9][a-z0-9]*+)?+)*+)([a-z][a-z0-9+.-]*+)"
#: The same where `www.` at a word's start, which is seen to by itself, isn't part of the name.
SCHEME_AFTER_WWW = SCHEME.replace("(?:[+.-]++", r"(?:(?:[+.-]++|(?<!\w)www\.)")
# What redaction takes out, in this order, and what it puts in.
REDACTIONS = [
    (rf"(?iU)(?:{SCHEME}://|\bwww\.)\S+", "$1[external link omitted]"),
    (r"(?iU)(?<![\w.+-])[\w.+-]+@[\w.-]+\.[a-z]{2,}(?![\w.-])", "[email omitted]"),
    (r"(?iU)(?:\\\\|//)[^\s]+|\b[a-z]:[\\/][^\s]+|(?<!\w)/(?:[^\s/]+/)*[^\s/]+", "[file location omitted]"),
    (r"(?U)\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "[redacted secret]"),
    (r"(?U)\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b", "[redacted secret]"),
    (r"(?iU)\bBearer\s+[A-Za-z0-9._~-]+|(?<![A-Za-z0-9_-])((?:(?!\beyJ)[A-Za-z0-9_-])*+)eyJ[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]+\b", "$1[redacted secret]"),
    (r"(?iU)\b(?:api[_-]?key|token|secret|password|authorization|access[_-]?key)\s*[:=]\s*[^\s,;]+", "[redacted secret]"),
    (r"(?iU)\b(?:sk|api[_-]?key|token|secret|password)[_-]?[=:]?[a-z0-9_-]{12,}\b", "[redacted secret]"),
]
FILE_PATH = REDACTIONS[2][0]
#: What a text must hold for each of these to match; most texts hold none, and this is quicker to tell.
GUARDS = [r"(?iu)://|www\.", "@", r"[/\\]", "A[KS]IA", "gh[pousr]_|github_pat_", r"(?iu)bearer\s|eyj", "[:=]", r"(?iu)(?:sk|key|token|secret|password)[_-]?[=:]?[a-z0-9_-]{12}"]
# Line starts that Markdown would read as blocks; reference files and notes differ in the last choice.
BLOCK = r"(?mdU)^( {0,3}(?:#{1,6}(?:\s|$)|>|[-+*][^\S\n]|\d+[.)][^\S\n]|`{3,}|~{3,}|%s))"
REFERENCE_BLOCK, NOTE_BLOCK = BLOCK % r"---\s*$", BLOCK % r"(?:=+|-+)\s*$"
# Device names that no path component may have as its stem.
RESERVED = r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\..*)?$"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def _relative(source: pd.Series, target: pd.Series) -> pd.Series:
    out = [quote(posixpath.relpath(t, posixpath.dirname(f) or "."), safe="/-._~") for f, t in zip(source, target, strict=True)]
    return pd.Series(out, dtype=object)


def bound(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f uses it; works within transform() too."""
    return F.element_at(F.transform(F.array(c), lambda x: f(x)), 1)


def markdown_link(label: Column, source: Column, target: Column) -> Column:
    """A link from one file to another, by relative path. label is in normal form."""
    return F.concat(F.lit("["), markdown_escaped(label), F.lit("]("), _relative(source, target), F.lit(")"))


def newlines(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def normalized(c: Column) -> Column:
    """Line ends as LF, then canonical composition. Null stays null."""
    return _nfc(newlines(c))


def sanitized(c: Column) -> Column:
    """Without invisible and bidirectional characters."""
    return F.regexp_replace(c, INVISIBLE, "")


def stripped(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_inline(c: Column) -> Column:
    """Runs of tab, CR, LF and space as one space, stripped."""
    return stripped(F.regexp_replace(c, r"[\t\r\n ]+", " "))


def collapsed(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def display(c: Column, fallback: str = "Untitled") -> Column:
    """One line of normalized text without control characters; fallback if nothing is left."""
    one = collapsed(F.regexp_replace(normalized(c), r"[\x{00}-\x{1F}\x{7F}-\x{9F}]", " "))
    return bound(one, lambda x: F.when(x == "", fallback).otherwise(x))


def lines(c: Column) -> Column:
    """The array of lines; a line end at the end makes no further line."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, rf"(?:{LINE_END})\z", ""), LINE_END))


def clipped(c: Column, limit: int) -> Column:
    """The longest prefix of whole characters that takes at most limit bytes in UTF-8."""
    return bound(c, lambda x: _clipped(x, limit))


def _clipped(c: Column, limit: int) -> Column:
    raw = c.cast("binary")
    inner = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")
    part = lambda n: F.substring(raw, 1, n).cast("string")
    cut = F.when(~inner(limit + 1), part(limit)).when(~inner(limit), part(limit - 1)).when(~inner(limit - 1), part(limit - 2)).otherwise(part(limit - 3))
    return F.when(F.octet_length(c) <= limit, c).otherwise(cut)


def clipped_reference(c: Column, limit: int) -> Column:
    """clipped, without white space at the end; an ellipsis if nothing is left."""
    return bound(F.regexp_replace(clipped(c, limit), f"{SPACE}+$", ""), lambda x: F.when(x == "", "…").otherwise(x))


def html_escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def redacted(c: Column) -> Column:
    """Links, addresses, paths and secrets taken out."""
    for guard, (pattern, put) in zip(GUARDS, REDACTIONS, strict=True):
        c = bound(c, lambda x, g=guard, p=pattern, w=put: F.when(x.rlike(g), F.regexp_replace(x, p, w)).otherwise(x))
    return c


def reference_text(c: Column, limit: int = 1000) -> Column:
    """Untrusted text as inert reference data: normalized, redacted, escaped, one line, at most limit bytes."""
    return reference_escaped(normalized(c), limit)


def reference_escaped(c: Column, limit: int = 1000) -> Column:
    """reference_text of text in normal form; JVM only, so it works within transform()."""
    c = redacted(F.regexp_replace(c, r"[\x{00}-\x{1F}\x{7F}-\x{9F}]", " "))
    c = F.replace(c, F.lit("allowed-tools:"), F.lit("tool permission directive:"))
    c = F.replace(html_escaped(c), F.lit("\\"), F.lit("\\\\"))
    c = F.regexp_replace(c, r"([`*_\[\]()])", r"\\$1")
    c = F.regexp_replace(F.regexp_replace(c, r"[\x{2028}\x{2029}]$", ""), r"[\x{2028}\x{2029}]", "\n")
    return clipped_reference(F.regexp_replace(c, REFERENCE_BLOCK, r"\\$1"), limit)


def markdown_text(c: Column) -> Column:
    """Untrusted text as inert Markdown that shows as it is."""
    return markdown_escaped(normalized(c))


def markdown_escaped(c: Column) -> Column:
    """markdown_text of text in normal form; JVM only."""
    c = F.replace(html_escaped(c), F.lit("\\"), F.lit("\\\\"))
    # within a scheme's name its stops too; then the colon, or the stop after www. Escaped HTML holds no "<" and ">", so they can
    # stand around a scheme for the moment; its stops are gone through from one to the next
    c = F.regexp_replace(c, rf"(?iU){SCHEME_AFTER_WWW}:(?=\S)", "$1<$2>:")
    c = F.regexp_replace(c, r"(?i)(<|(?!^)\G)([a-z0-9+-]*+)\.", r"$1$2\\.")
    c = F.replace(F.replace(c, F.lit(">:"), F.lit("\\:")), F.lit("<"), F.lit(""))
    c = F.regexp_replace(c, r"(?iU)\b(www)\.(?=\S)", r"$1\\.")
    c = F.regexp_replace(c, r"(?iU)(?<![\w.+-])([\w.+-]+)@([\w.-]+\.[a-z]{2,})(?![\w.-])", r"$1\\@$2")
    c = F.regexp_replace(c, r"([`*_\[\]])", r"\\$1")
    return F.regexp_replace(c, NOTE_BLOCK, r"\\$1")


def safe_component(c: Column, fallback: str, limit: int = 80) -> Column:
    """A portable file name; if it differs from the text, a digest of the text follows, so that names stay apart."""
    end = lambda x: F.regexp_replace(x, r"[ .]+$", "")

    def make(whole):
        name = F.regexp_replace(collapsed(whole), r'[\\/:*?"<>|%]+', "-")
        name = F.regexp_replace(F.regexp_replace(name, r"\p{C}", ""), r"^[ .-]+|[ .-]+$", "")
        name = bound(name, lambda x: F.when(x == "", fallback).otherwise(x))
        name = bound(name, lambda x: F.when(x.rlike(RESERVED), F.concat(F.lit(f"{fallback}-"), x)).otherwise(x))
        cut = bound(end(clipped(name, limit)), lambda x: F.when(x == "", fallback).otherwise(x))
        digest = lambda x: F.concat(end(clipped(x, limit - 10)), F.lit("--"), F.substring(F.sha2(whole, 256), 1, 8))
        return bound(cut, lambda x: F.when(x == whole, x).otherwise(digest(x)))

    return bound(normalized(c), make)


def slug(c: Column, fallback: str, limit: int) -> Column:
    """Lower-case ASCII letters and digits of the reference text, joined by hyphens."""
    dashes = lambda x: F.regexp_replace(x, "^-+|-+$", "")
    out = dashes(F.regexp_replace(F.lower(_ascii(reference_text(c, limit))), "[^a-z0-9]+", "-"))
    kept = lambda x: F.when(x == "", fallback).otherwise(x)
    return bound(dashes(F.substring(bound(out, kept), 1, limit)), kept)


def safe_locator(c: Column) -> Column:
    """A source's place as reference text; places that look like paths are not shown."""
    return bound(normalized(c), lambda n: F.when(n == "", "").when(n.rlike(FILE_PATH) | n.rlike(r"^[/\\]"), "Source location omitted.").otherwise(reference_escaped(n)))


def safe_fingerprint(c: Column) -> Column:
    """A SHA-256 in hex as it is, any other text's own."""
    return bound(normalized(c), lambda n: F.when(n.rlike("^[0-9a-f]{64}$"), n).otherwise(F.sha2(n, 256)))


def is_relative_path(c: Column, most: int = 240, most_component: int = 120) -> Column:
    """Is it a portable relative path of portable components? Null is not."""
    n = _nfc(c)
    bad = lambda x: (x == "") | x.isin(".", "..") | x.rlike(f"^{SPACE}|{SPACE}$|[. ]$") | (F.octet_length(x) > most_component) | x.rlike(RESERVED) | x.rlike(r'\p{C}|[%:*?"<>|]')
    fine = (n != "") & ~n.rlike(r"^/|\\") & (F.octet_length(n) <= most) & ~F.exists(F.split(n, "/"), bad)
    return F.coalesce(fine, F.lit(False))


def chapter_path(index: Column, slug_: Column, most: int | None = 5000) -> Column:
    """The one shape of a chapter's file, from its index from 0; null if index or slug don't fit. most: chapters of a book (None:
    no bound; numbers have five digits from 10,000 on)."""
    fits = (index >= 0) & slug_.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")
    if most is not None:
        fits &= index < most
    return F.when(fits, F.format_string("chapters/ch%04d-%s.md", (index + 1).cast("int"), slug_))


def yaml_string(c: Column) -> Column:
    """Display text in JSON quotes."""
    return bound(F.to_json(F.array(display(c))), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))
