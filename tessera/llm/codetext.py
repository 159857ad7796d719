"""Natural language in comments and string literals of source files: where it is, which language, which share.

The library's scanner yields the comments and string literals of JavaScript (regular expressions and template
substitutions told apart). One Aho-Corasick pass over each span finds the function words of all spaced languages, checked at word
boundaries; each word votes for its languages with the inverse of how many languages share it, and the ranges of the
script settle Japanese, Chinese and Korean.

Defined results: null and empty files have no span; an unclosed comment or literal ends with the file (a quoted one
with its line); line ends may be mixed; files stored twice count once; files are scanned whole; an empty table gives
no rows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.javascript import braces_end, spans, unescape

#: Function words of the spaced languages (fixed values).
WORDS = {
    "en": "the of and to in is are was were be been being have has had do does did not no it its this that these those there here i you he she we they me him her us them my your his our their what which who whom when where why how if then than so but or nor for from with without about into onto over under before after since until while as at by on off out up down can could will would shall should may might must never ever only just once more most much many some any each every all both nothing nobody anyone someone let too very again still",
    "fr": "le la les l un une des du de d et ou où mais donc car ni que qu qui quoi dont ce cet cette ces c il elle ils elles on nous vous je j tu me m te t se s lui leur leurs mon ma mes ton ta tes son sa ses notre nos votre vos est sont était étaient été être a ont avait avoir ai as ne n pas plus rien jamais personne dans sur sous avec sans pour par chez vers entre depuis avant après quand si comme comment pourquoi alors puis ensuite toujours selon aussi très bien tout toute tous toutes même autre autres encore déjà ici là y en au aux",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber denn doch sondern nicht kein keine keinen keiner nichts ist sind war waren sein bin bist hat haben hatte habe hast wird werden wurde ich du er sie es wir ihr mich dich ihn uns euch mir dir ihm ihnen mein dein unser euer sich man wer was wie wo wann warum wenn weil dass ob als bis bei mit nach von vor zu zum zur auf an am im in ins aus über unter um durch für ohne gegen seit nur noch schon auch sehr so dann wieder hier dort jetzt immer nie mehr viel viele alle alles etwas jemand niemand",
    "es": "el la los las lo un una unos unas y e o u pero sino ni que quien quienes cual cuales cuyo este esta estos estas ese esa esos esas eso esto aquel aquella aquello yo tú él ella ellos ellas nosotros vosotros usted ustedes me te se le les nos os mi mis tu tus su sus nuestro nuestra es son era eran fue ser está están estaba he ha han había hay no nada nadie nunca ya más menos muy mucho muchos todo toda todos todas otro otra otros otras de del a al en con sin por para sobre entre hasta desde hacia antes después cuando como cómo dónde donde porque si enseguida luego entonces mientras aunque además según tras también aquí allí solo aún todavía",
}
#: Letters that narrow the spaced languages down (fixed values).
LETTERS = {c: langs for chars, langs in (("ñ¿¡áíóú", ("es",)), ("çœàèêâîôûë", ("fr",)), ("äöß", ("de",)), ("é", ("fr", "es")), ("ü", ("de", "es"))) for c in chars}
LANGS = ("ja", "en", "zh", "ko", "fr", "de", "es")

def content(src: str, start: int, end: int, kind: str) -> str:
    """The text of a span: marks, comment frames, substitutions and escapes resolved."""
    raw = src[start:end]
    if kind == "line":
        return raw[2:]
    if kind == "block":
        return re.sub(r"(?m)^[ \t]*\*+ ?", "", raw[2:-2] if raw.endswith("*/") and len(raw) > 3 else raw[2:])
    body = raw[1:-1] if len(raw) > 1 and raw[-1] == raw[0] else raw[1:]
    if kind == "tpl":
        out, i = [], 0
        while (j := body.find("${", i)) >= 0:
            if j and body[j - 1] == "\\":
                out.append(body[i : j + 2])
                i = j + 2
                continue
            out.append(body[i:j])
            i = braces_end(body, j + 2)
        body = "".join([*out, body[i:]])
    return unescape(body)


_JUNK = re.compile(
    r"\\[nN]<[^<>]*>|\\[A-Za-z]+(?:\[[^\[\]]*\])?|\\[^A-Za-z\s]|@[\w-]+|~?struct~\w+|<[^<>\n]{1,60}>|#[0-9A-Fa-f]{3,8}\b|https?://\S+|%\d+|\{\d+\}"
    r"|\$\{[^{}]*\}|(?:\.{0,2}/)?[\w.\-*]+(?:/+[\w.\-*]+)+|\b[\w\-]+\.(?:js|json|png|jpg|ogg|m4a|ttf|woff2?|otf|css|txt|webm|mp4)\b"
)
_CODE_SIGN = re.compile(
    r"\b\d+(?:\.\d+)?(?:px|pt|em|rem|vh|vw)\b|[;{]\s*$|^\s*\}|[=!<>]==?|&&|\|\||=>|\+\+|--(?!-)|\+=|-=|\w\s*\([^)\n]*\)\s*[;{.]|[\w\])]\.\w+\s*[(=\[]|^\s*(?:var|let|const)\s+[\w$]+|\breturn\b[^.!?]*;|\bfunction\b\s*\w*\s*\(|^\s*[\w$.\[\]]+\s*[-+*/]?=\s*[^=]|^\s*[\w$.]+\([^\n]*\);?\s*$|\bnew\s+[A-Z]\w*\(|^\s*(?:if|for|while|switch)\s*\("
)
_KANA, _HIRA, _HAN, _HANGUL = (re.compile(x) for x in ("[ぁ-ゖァ-ヺー]", "[ぁ-ゖ]", "[一-鿿㐀-䶿々]", "[가-힣]"))
_LATIN_WORD = re.compile(r"[^\W\d_ぁ-ヿ㐀-鿿가-힣]+")
#: Votes from which a text of a spaced language counts as natural, and the words of two letters or more that make a phrase.
LEAST_VOTES = 1.0
LEAST_WORDS = 2


@functools.cache
def _automaton():
    import ahocorasick

    langs: dict[str, list[str]] = {}
    for lang, words in WORDS.items():
        for w in set(words.split()):
            langs.setdefault(w, []).append(lang)
    a = ahocorasick.Automaton()
    for w, of in langs.items():
        a.add_word(w, (len(w), tuple(of), 1 / len(of)))
    a.make_automaton()
    return a


def votes(text: str) -> dict[str, float]:
    """Inverse-language-frequency votes of the function words in a text, by one pass of the automaton."""
    low = text.lower().replace("’", "'")
    out = dict.fromkeys(WORDS, 0.0)
    for end, (n, of, weight) in _automaton().iter(low):
        i = end - n + 1
        if (i == 0 or not (low[i - 1].isalnum() or low[i - 1] in "_$")) and (end + 1 == len(low) or not (low[end + 1].isalnum() or low[end + 1] in "_$")):
            for lang in of:
                out[lang] += weight
    for c in low:
        if c > "\x7f" and (of := LETTERS.get(c)):
            for lang in of:
                out[lang] += 0.5 / len(of)
    return out


def _cjk(text: str) -> str | None:
    hira, kana, han, hangul = (len(x.findall(text)) for x in (_HIRA, _KANA, _HAN, _HANGUL))
    latin = sum(map(len, _LATIN_WORD.findall(text)))
    if hangul > 1 and hangul >= kana + han and hangul > latin / 3:
        return "ko"
    if (hira and hira + kana + han > 3 or hira > 1) and kana + han > latin / 3:
        return "ja"
    if han > 2 and han > latin / 3:
        return "zh" if kana < han / 2 else "ja"
    return None


def language(text: str) -> str | None:
    """The language of a span's text, or None where it holds no phrase of natural language."""
    text = unicodedata.normalize("NFC", text)
    bare = _JUNK.sub(" ", text)
    if not bare.strip():
        return None
    lines = [x for x in bare.split("\n") if x.strip()]
    prose = [x for x in lines if not _CODE_SIGN.search(x)]
    body = "\n".join(prose)
    if (c := _cjk(body)) is not None:
        return c
    words = _LATIN_WORD.findall(body)
    if sum(len(w) > 1 for w in words) < LEAST_WORDS:
        return None
    v = votes(body)
    best = max(v, key=lambda k: v[k])
    return best if v[best] >= LEAST_VOTES else None


def _found(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["file_id", "start_index", "lang", "kind", "chars", "file_chars"]
    for b in files:
        rows = []
        for fid, src in zip(b["file_id"], b["source_text"], strict=True):
            if not src:
                continue
            for start, end, kind in spans(src):
                if (lang := language(content(src, start, end, kind))) is not None:
                    rows.append((fid, start, lang, "comment" if kind in ("line", "block") else "literal", end - start, len(src)))
        yield pd.DataFrame(rows, columns=cols)


def natural_spans(files: DataFrame) -> DataFrame:
    """``plugin_source_files`` -> one row per comment or literal with natural language: file_id, start_index (code
    points), lang, kind, chars of the span and of the file. A file stored twice counts as it was last loaded."""
    f = files.where("file_id is not null").groupBy("file_id").agg(F.max_by("source_text", F.struct(F.col("loaded_at").isNotNull(), "loaded_at")).alias("source_text"))
    return f.mapInPandas(_found, "file_id long, start_index int, lang string, kind string, chars int, file_chars int")


def shares(found: DataFrame) -> DataFrame:
    """Each language's share of each file's characters."""
    return found.groupBy("file_id", "lang").agg(F.count("*").alias("spans"), F.sum("chars").alias("chars"), (F.sum("chars") / F.max("file_chars")).alias("share"))


def literal_languages(candidates: DataFrame) -> DataFrame:
    """``plugin_source_candidates`` (decoded literals) -> those with natural language, once each, with their place."""

    @F.pandas_udf("string")
    def lang(s: pd.Series) -> pd.Series:
        return s.map(lambda t: language(t) if t else None).astype(object)

    key = ["game_id", "file_id", "file_name", "start_index", "context"]
    return candidates.select(*key, lang("text").alias("lang")).where("lang is not null").distinct()
