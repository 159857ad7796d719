"""Broken original/translation pairs: ordered rules that emit every triggered defect type.

Rules, in order: ``empty``, ``refusal`` (phrases of seven languages), ``copy`` (the original again, alone, behind a
short heading or as at least half of the answer), ``wrong_language`` (script mismatch), ``truncated`` (unclosed delimiters, a broken control code or a dash at
the end, fewer sentences than the original, or an abrupt ending). Whether an ending without a stop is abrupt is
decided by the corpus itself: how often the last characters stand before a stop among all their occurrences in
finished translations; an ending that the corpus doesn't know stays undecided and is no defect.

Defined results: a pair whose original has no visible text is no case; null lists and null lines are empty; rows
stored twice count once; texts of any length are judged whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread, stored

#: Characters of context, longest first, that an ending is judged by.
ORDERS = (8, 5, 3, 2)
GAPS = (2, 3, 4)
#: An ending is whole if it stands before a stop in at least this share of its occurrences.
WHOLE_SHARE = 0.1
#: Occurrences from which a context is trusted.
SEEN = 3

_GONE = {p: None for p in [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xE0100, 0xE01F0)]}
_CODE = re.compile(r"\\[nN]<[^<>]*>|\\[A-Za-z]+\[[^\[\]]*\]|\\[A-Za-z]+(?=[^A-Za-z\[]|$)|\\[^A-Za-z\s]")
_CUT_CODE = re.compile(r"\\[A-Za-z]*\[?[^\[\]\\]{0,6}$")
_STOPS = re.compile(r"[。！？!?｡]+[」』”’\"'）)】\s]*|\.+(?=[\s」』”’\"'）)]|$)[」』”’\"'）)\s]*|\n+")
_KANA, _HIRA, _HANGUL, _HAN = (re.compile(x) for x in ("[ぁ-ゖァ-ヺ]", "[ぁ-ゖ]", "[가-힣ᄀ-ᇿ]", "[一-鿿㐀-䶿々]"))
_FINISHED = re.compile(r"[^。！？!?\n]+(?=[。！？!?])")
_DIGITS = re.compile(r"\d+")
_QUOTES = " 　\"“”「」"
_LATIN = re.compile(r"[^\W\d_ぁ-ヿ㐀-鿿가-힣]")
_WORD = re.compile(r"[^\W\d_ぁ-ヿ㐀-鿿가-힣]*[a-zß-ÿа-яα-ω][^\W\d_ぁ-ヿ㐀-鿿가-힣]*")

#: Refusal phrases (fixed values), by language of the answer.
REFUSALS = [
    r"(无法|不能|没有办法|没法|不便|不予|拒绝|难以)[^。]{0,8}(翻译|处理|协助|回答|这项请求|该请求)",
    r"(作为|身为)[^。，]{0,8}(语言模型|人工智能|AI|翻译助手)",
    r"超出[^。]{0,12}(范围|能力)",
    r"(信息|上下文)不足|提供更多(上下文|信息)",
    r"不符合[^。]{0,8}(规范|政策|准则|规定)",
    r"(翻訳|訳|ご依頼|ご要望|処理)[^。]{0,16}(できません|できかね|いたしかね|致しかね|お断り|足りません|不足)",
    r"(AI|言語モデル|翻訳アシスタント)として[^。]{0,30}(ません|お断り|かね)",
    r"\b(can'?t|cannot|can not|unable to|not able to|must decline|have to decline|won't|refuse)\b[^.]{0,40}\b(translat\w*|render\w*|process\w*|assist\w*|comply|help with (that|this|the) (request|text|content)|this (text|passage|content|request))",
    r"\bunable to help with that request|need more context|under my guidelines|\bas an? (ai|language model|translation assistant)\b|against (my|our) (policy|policies|guidelines)",
    r"(번역|요청|처리)[^.]{0,14}(수 없|어렵|불가|거절|못)|언어 모델로서|AI로서|(정보|문맥)[이가]? 부족",
    r"(ne (peux|puis|suis) pas|impossible de|refuse de|dans l'incapacité de)[^.]{0,40}(tradui\w*|traiter|ce texte|cette demande)|en tant qu(e|')\s?(ia|modèle|assistant)|besoin de plus de contexte",
    r"(kann|könnte|darf|muss)[^.]{0,50}(nicht|ablehnen)[^.]{0,24}(übersetz\w*|bearbeit\w*|verarbeit\w*)|als (ki|sprachmodell|übersetzungsassistent)\b|mehr kontext|gegen meine richtlinien",
    r"(no puedo|no me es posible|no es posible|debo rechazar)[^.]{0,40}(traduc\w*|procesar|este texto|esta solicitud)|como (modelo de lenguaje|ia|asistente)\b|necesito más contexto|mis directrices",
]
_REFUSAL = re.compile("|".join(f"(?:{x})" for x in REFUSALS), re.I)


def _plain(text: str) -> str:
    return unicodedata.normalize("NFKC", text.translate(_GONE))


def _key(text: str) -> str:
    return "".join(c for c in text.casefold() if c.isalnum())


def _has_language(bare: str) -> bool:
    return bool(_KANA.search(bare) or _HANGUL.search(bare) or len(_HAN.findall(bare)) > 1 or len(_WORD.findall(bare)) > 1)


def _sentences(bare: str) -> int:
    return sum(any(c.isalnum() for c in s) for s in _STOPS.split(bare))


def _tail(bare: str) -> str:
    """The last sentence of a text that doesn't end in a stop, digits made alike; '' if it ends in one."""
    s = bare.rstrip()
    if not s or re.search(r"[。！？!?.…」』”’\"'）)】]$", s):
        return ""
    return "^" + _DIGITS.sub("0", _STOPS.split(s)[-1].strip(_QUOTES))


def judge(original: str, answer: str, kind: str | None) -> tuple[list[str], str]:
    """All rules but the corpus one: the defect types triggered, in order, and the ending still to be judged. An empty
    answer can trigger no other rule, and only an answer in Chinese can break off before its end."""
    o, t = _plain(original), _plain(answer)
    bo, bt = _CODE.sub("", o), _CODE.sub("", t)
    if not any(c.isprintable() and not c.isspace() for c in bo):
        return [], ""
    if not any(c.isprintable() and not c.isspace() for c in bt):
        return ["empty"], ""
    found = []
    if _REFUSAL.search(bt) and not _REFUSAL.search(bo):
        found.append("refusal")
    language = _has_language(bo)
    ko, kt = _key(bo), _key(bt)
    # the whole original again: alone, behind a heading, or as the greater part of the answer
    if language and ko and ko in kt and len(kt) - len(ko) <= max(24 if re.match(r"[^:]{1,30}:", bt.lstrip()) else 12, len(ko)):
        found.append("copy")
    han, kana, hira, hangul, latin = (len(x.findall(bt)) for x in (_HAN, _KANA, _HIRA, _HANGUL, _LATIN))
    words = len(_WORD.findall(bt))
    if language and ((hira > 1 and hira + kana > 0.3 * (hira + kana + han)) or hangul > han or kana > han + 1 or (words > 1 and latin > 2 * han)):
        found.append("wrong_language")
    tail = ""
    if han and "wrong_language" not in found:
        end = bt.rstrip()
        o_end = bo.rstrip()
        cut = _CUT_CODE.search(end) if not _CUT_CODE.search(o_end) else None
        dash = re.search(r"(…|\.\.\.|—|――|-{2,}|,|、)[」』”’\"']?$", end) and not re.search(r"(…|\.\.\.|—|――|-{2,}|,|、)[」』”’\"']?$", o_end)
        open_ = any(t.count(a) > t.count(b) and o.count(a) <= o.count(b) for a, b in ("「」", "『』", "“”", "()", "【】"))
        if cut or dash or open_ or (kind != "short_text" and _sentences(bt) < _sentences(bo)):
            found.append("truncated")
        elif kind == "long_text":
            tail = _tail(bt)
    return found, tail


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [judge(o or "", t or "", k) for o, t, k in zip(b["o"], b["t"], b["kind"], strict=True)]
        r = pd.DataFrame({"fact_id": b["fact_id"], "defects": [x for x, _ in out], "tail": [y for _, y in out]})
        yield r[(r["defects"].str.len() > 0) | (r["tail"] != "")]


def _contexts(s: str, j: int) -> Iterator[tuple[int, str]]:
    """What stands before place ``j`` of a sentence: its last characters, and four characters before a gap of two to
    four (a name of any spelling), each with its rank."""
    for k in ORDERS:
        yield k, s[max(0, j - k) : j]
    for m in GAPS:
        if j - m >= 4:
            yield 4, s[j - m - 4 : j - m] + "*" * m


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences of each context, and those before a stop, summed over a task's rows before anything is shuffled
    (and handed on early whenever they are many)."""
    seen: Counter = Counter()
    ends: Counter = Counter()

    def out() -> Iterator[pd.DataFrame]:
        grams = list(seen)
        for i in range(0, len(grams), 20_000):
            part = grams[i : i + 20_000]
            yield pd.DataFrame({"gram": part, "seen": [seen[g] for g in part], "ends": [ends.get(g, 0) for g in part]})
        seen.clear()
        ends.clear()

    for b in batches:
        sentences: Counter = Counter()
        for t in b["t"].dropna():
            bare = _CODE.sub("", _plain(t))
            if _HAN.search(bare) and not _HIRA.search(bare):
                for s in _FINISHED.findall(bare):
                    sentences["^" + _DIGITS.sub("0", s.strip(_QUOTES))] += 1
        for s, n in sentences.items():
            for j in range(2, len(s) + 1):
                for _, g in _contexts(s, j):
                    seen[g] += n
            for _, g in _contexts(s, len(s)):
                ends[g] += n
        if len(seen) > 400_000:
            yield from out()
    yield from out()


def _open_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, k, g) for f, t in zip(b["fact_id"], b["tail"], strict=True) for k, g in _contexts(t, len(t))]
        yield pd.DataFrame(rows, columns=["fact_id", "k", "gram"])


def defects(items: DataFrame) -> DataFrame:
    """``translation_items`` -> ``(fact_id, defects)``: every defect type triggered, in the rules' order."""
    rows = spread(items.where("fact_id is not null").select("fact_id", F.array_join("original_lines", "\n").alias("o"), F.array_join("translation_lines", "\n").alias("t"), F.col("item_type").alias("kind")))
    judged = stored(items.sparkSession, rows.mapInPandas(_judged, "fact_id string, defects array<string>, tail string").dropDuplicates(["fact_id"]), "judged")
    # a row stored twice is one occurrence
    once = rows.where("t <> ''").groupBy(F.unhex(F.md5("fact_id")).alias("h")).agg(F.first("t").alias("t")).select("t")
    grams = once.mapInPandas(_endings, "gram string, seen long, ends long").groupBy("gram").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))
    open_ = judged.where("tail <> ''").select("fact_id", "tail").mapInPandas(_open_contexts, "fact_id string, k int, gram string")
    best = (
        open_.join(grams, "gram")
        .where(F.col("seen") >= SEEN)
        .groupBy("fact_id")
        .agg(F.max(F.struct("k", (F.col("ends") / F.col("seen")).alias("share"))).alias("best"))
        .where(F.col("best.share") < WHOLE_SHARE)
        .select("fact_id")
    )
    abrupt = judged.where("tail <> ''").join(best, "fact_id").select("fact_id", F.concat("defects", F.array(F.lit("truncated"))).alias("defects"))
    rest = judged.where("size(defects) > 0").join(abrupt.select("fact_id"), "fact_id", "left_anti").select("fact_id", "defects")
    return rest.unionByName(abrupt)



def first_defect(found: DataFrame) -> DataFrame:
    """One defect a pair: the first rule that was triggered."""
    return found.select("fact_id", F.col("defects")[0].alias("defect"))
