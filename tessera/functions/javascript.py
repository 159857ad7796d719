"""Comments and string literals of JavaScript, told apart from regular expressions and template substitutions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"(?P<line>//[^\n\r\u2028\u2029]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<str>\"(?:\\(?:\r\n|.)|[^\"\\\n\r])*(?:\"|(?=[\n\r])|\Z)|'(?:\\(?:\r\n|.)|[^'\\\n\r])*(?:'|(?=[\n\r])|\Z))"
    r"|(?P<tpl>`)|(?P<slash>/)|(?P<word>[\w$]+)|(?P<space>\s+)|(?P<other>.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\]|[^/\\\[\n\r])+/[A-Za-z]*")
#: Words after which a slash starts a regular expression (fixed values).
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}


def _template_end(src: str, i: int) -> int:
    """The place behind the template literal that opens at ``i``."""
    n = len(src)
    i += 1
    while i < n:
        c = src[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and src.startswith("${", i):
            i = braces_end(src, i + 2)
        else:
            i += 1
    return n


def braces_end(src: str, i: int) -> int:
    """The place behind the brace that closes the one before ``i``."""
    depth = 1
    while i < len(src):
        m = _TOKEN.match(src, i)
        if m.lastgroup == "tpl":
            i = _template_end(src, i)
            continue
        if m.lastgroup == "other":
            depth += {"{": 1, "}": -1}.get(m.group(), 0)
        i = m.end()
        if depth == 0:
            return i
    return i


def spans(src: str) -> Iterator[tuple[int, int, str]]:
    """``(start, end, kind)`` of each comment (``line``, ``block``) and literal (``str``, ``tpl``), in order."""
    i, before, n = 0, "", len(src)
    while i < n:
        m = _TOKEN.match(src, i)
        kind = m.lastgroup
        if kind == "tpl":
            end = _template_end(src, i)
            yield i, end, kind
            i, before = end, "v"
            continue
        if kind == "slash":
            r = _REGEX.match(src, i) if before != "v" else None
            i, before = (r.end(), "v") if r else (m.end(), "")
            continue
        if kind in ("line", "block", "str"):
            yield i, m.end(), kind
            if kind == "str":
                before = "v"
        elif kind == "word":
            before = "" if m.group() in _BEFORE_REGEX else "v"
        elif kind == "other":
            before = "v" if m.group() in ")]}" else ""
        i = m.end()


_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|.))", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def unescape(body: str) -> str:
    """What the escaped characters of a literal stand for."""

    def one(m: re.Match) -> str:
        h = m[1] or m[2] or m[3]
        if h:
            return chr(p) if (p := int(h, 16)) < 0x110000 else ""
        return _SIMPLE.get(m[4], "" if m[4] in ("\n", "\r\n", "\r") else m[4])

    out = _ESCAPE.sub(one, body)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if "\\u" in body else out


def escape(text: str, quote: str) -> str:
    """A literal's body that stands for ``text`` within ``quote``."""
    out = text.replace("\\", "\\\\").replace(quote, "\\" + quote).replace("\r", "\\r")
    return out.replace("${", "\\${") if quote == "`" else out.replace("\n", "\\n")


def _literals(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["file_id", "start_index", "end_index", "quote", "line", "raw_text", "text"]
    for b in files:
        rows = []
        for fid, src in zip(b["file_id"], b["source_text"], strict=True):
            line, seen = 1, 0
            for start, end, kind in spans(src or ""):
                if kind in ("str", "tpl"):
                    line, seen = line + len(_BREAK.findall(src, seen, start)), start
                    raw = src[start + 1 : end - (src[end - 1] == src[start] and end - start > 1)]
                    rows.append((fid, start, end, src[start], line, raw, unescape(raw)))
        yield pd.DataFrame(rows, columns=cols)


_BREAK = re.compile(r"\n")


def string_literals(files: DataFrame) -> DataFrame:
    """The string literals of each file ``(file_id, source_text)`` with their place, quote, line and text."""
    kind = "file_id long, start_index int, end_index int, quote string, line int, raw_text string, text string"
    return files.select("file_id", "source_text").mapInPandas(_literals, kind)


def spliced(src: str, edits: list[tuple[int, int, str, str]]) -> tuple[str, list[tuple[int, str]], str | None]:
    """A source with literals ``(start, end, raw text, new text)`` replaced, where each now begins with its raw text, and
    why it can't be done: a literal isn't what was stored, two edits overlap, or the result, read again, doesn't hold
    every new text as a literal where it was put."""
    out, places, at, moved = [], [], 0, 0
    for start, end, raw, new in sorted(edits):
        closed = end - start > 1 and src[end - 1 : end] == src[start : start + 1]
        if start < at:
            return src, [], "edits_overlap"
        if end > len(src) or src[start + 1 : end - closed] != raw:
            return src, [], "source_changed"
        body = escape(new, src[start])
        out += [src[at : start + 1], body]
        places.append((start + moved, body))
        moved += len(body) - len(raw)
        at = end - closed
    text = "".join([*out, src[at:]])
    found = {a: text[a + 1 : b - (b - a > 1 and text[b - 1] == text[a])] for a, b, kind in spans(text) if kind in ("str", "tpl")}
    if any(found.get(a) != body or unescape(body) != new for (a, body), (_, _, _, new) in zip(places, sorted(edits), strict=True)):
        return src, [], "syntax_changed"
    return text, places, None


def splice(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Put new texts in place of literals: ``edits`` are ``(file_id, start_index, end_index, raw_text, new_text)``.

    A file is written whole or not at all, and then the row says why. Returns file_id, content, changed, failure, and the
    map of what was written: where each new literal begins, its raw text and hash.
    """

    def apply(key: tuple, f: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        src, places, failure = None, [], "file_missing"
        if not f.empty:
            rows = list(e[["start_index", "end_index", "raw_text", "new_text"]].itertuples(index=False, name=None))
            src, places, failure = spliced(f["source_text"].iloc[0] or "", rows)
        written = [{"start_index": a, "raw_text": t, "sha256": hashlib.sha256(t.encode("utf-8", "replace")).hexdigest()} for a, t in places]
        return pd.DataFrame({"file_id": [key[0]], "content": [src], "changed": [len(places)], "failure": [failure], "written": [written]})

    out = "file_id long, content string, changed int, failure string, written array<struct<start_index:int,raw_text:string,sha256:string>>"
    return files.select("file_id", "source_text").groupBy("file_id").cogroup(edits.groupBy("file_id")).applyInPandas(apply, out)


def manifest(files: DataFrame) -> DataFrame:
    """Path, sha256 and size in bytes of each file."""
    return files.select("file_id", F.sha2("source_text", 256).alias("sha256"), F.octet_length("source_text").cast("long").alias("bytes"))


#: What a stored scan must have been made with to be used again: of the scanner, the rules and the table.
VERSIONS = {"scanner_version": 1, "rules_version": 1, "schema_version": 1}


def as_cache(scan: DataFrame, files: DataFrame, versions: dict[str, int] | None = None) -> DataFrame:
    """A scan as it is stored for later: with the hash of its file and the versions it was made with."""
    marked = scan.join(files.select("file_id", F.sha2("source_text", 256).alias("sha256")), "file_id")
    return marked.select("*", *[F.lit(v).alias(k) for k, v in {**VERSIONS, **(versions or {})}.items()])


def with_cache(files: DataFrame, cache: DataFrame, scan) -> DataFrame:
    """Scan only files whose hash the cache doesn't hold under the present versions; ``cache`` as of ``as_cache``."""
    hashed = files.withColumn("sha256", F.sha2("source_text", 256))
    valid = F.lit(True)
    for name, v in VERSIONS.items():
        valid = valid & (F.col(name) == v)
    own = cache.where(valid).drop(*VERSIONS)
    known = own.join(hashed.select("file_id", "sha256"), ["file_id", "sha256"], "left_semi").drop("sha256")
    fresh = scan(hashed.join(own.select("file_id", "sha256").distinct(), ["file_id", "sha256"], "left_anti"))
    return known.select(*fresh.columns).unionByName(fresh)
