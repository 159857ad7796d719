"""Language of each document and of each run of one language inside it, with a confidence.

Sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader
(FTRL-proximal) under elastic-net penalties and calibrated by temperature. The model is fitted on a bounded sample of
labelled documents (``SAMPLE_DOCS``, the smallest hashes of doc_id) and applied to every sentence of every text in
Arrow batches: n-grams are hashed and scored with array operations, never character by character.

Defined results: null, empty and blank texts and texts without any words (names, codes, paths, numbers, symbols) have
no run; texts are processed whole; repeated rows give the same runs; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.forms import form_table
from tessera.session import spread

LANGS = ("ja", "en", "zh", "ko", "fr", "de", "es")
#: Bounds of the training sample: documents, sentences of one document, and sentences of all.
SAMPLE_DOCS = 4000
DOC_SENTENCES = 20
SAMPLE_SENTENCES = 25_000
#: Features: the first few stand for the scripts, the others for hashed n-grams.
BUCKETS = 1 << 18
SCRIPTS = 4
ORDERS = (1, 2, 3)
#: Below this confidence a sentence takes the language of its neighbours.
SURE = 0.5

#: Spellings of language labels besides the two-letter code (fixed values).
NAMES = {
    "ja": "jpn japanese 日本語 jp", "en": "eng english 英語", "zh": "zho chi cmn chinese mandarin 中文 汉语 漢語", "ko": "kor korean 한국어",
    "fr": "fra fre french français", "de": "deu ger german deutsch", "es": "spa spanish español castilian",
}
_CODES = {name: code for code, names in NAMES.items() for name in [code, *names.split()]}


def label_language(label: Column) -> Column:
    """The language a label names (case, region, script, three-letter code and English name aside), or null."""
    first = F.lower(F.regexp_extract(F.trim(label), r"^([^\s_\-]+)", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv]), first)


_NOISE = re.compile(
    r"\\[nN]<[^<>]*>|\\[A-Za-z]+(?:\[[^\[\]]*\])?|\\[^A-Za-z]|\[[A-Z_0-9]+\]|<[^<>\s]{1,40}>|0x[0-9A-Fa-f]+|[A-Za-z0-9_.\-]*(?:/[A-Za-z0-9_.*\-]+)+"
    r"|\b[A-Za-z0-9_]+\.(?:js|json|png|ogg|m4a|txt|rvdata2?)\b|https?://\S+|[A-Za-z]+[0-9_]+[A-Za-z0-9_]*"
)
_SPLIT = re.compile(r"\n+|(?<=[。！？!?])|(?<=\.)(?=\s|[^\x00-\x7f])")
_LOWER = re.compile(r"(?<![^\W_])[a-zß-öø-ÿœ][a-zß-öø-ÿœ'’]+")
_NUMBER = re.compile(r"[0-9０-９.,:/%]*[0-9０-９]+")
_HIRA, _HAN, _HANGUL, _LATIN = (re.compile(x) for x in ("[ぁ-ゖ]", "[一-鿿㐀-䶿々]", "[가-힣]", "[A-Za-zÀ-ÖØ-öø-ÿœŒ]"))
_FOLD = re.compile("[̀-ͯͰ-ӿᄀ-ᇿ -‏ - ⁠-⁯⺀-⿟゙゚豈-﫿︀-️﻿＀-￯\U000e0100-\U000e01ef\xa0\xad]")


def sentences(text: str, table: dict[int, str]) -> list[str]:
    """The sentences of a text without what belongs to no language; only those with enough to tell a language by."""
    if _FOLD.search(text):
        text = unicodedata.normalize("NFC", text.translate(table))
    out = []
    for s in _SPLIT.split(_NOISE.sub(" ", text)):
        if len(s) < 2:
            continue
        if _HIRA.search(s) or len(_HAN.findall(s)) > 1 or len(_HANGUL.findall(s)) > 1:
            out.append(s)
        else:
            low = _LOWER.findall(s)
            if len(low) > 1 or (low and len(low[0]) > 4):
                out.append(s)
    return out


def _script(s: str) -> int:
    """Which script a sentence is mainly written in: hiragana beside Han, Hangul, Han alone, Latin letters."""
    hangul, hira, han, latin = (len(x.findall(s)) for x in (_HANGUL, _HIRA, _HAN, _LATIN))
    if hangul > latin / 2:
        return 1
    if hira > 0 and hira + han > latin / 3:
        return 0
    return 2 if han > latin / 3 else 3


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS x languages, float32, mostly zeros
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    noise: float = 0.0  # share of the held-out labels that were drawn at random
    last: int = -(2**63)  # greatest document hash of the training sample


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, and a feature of each one's script, with each one's text; n-grams that cross a
    text's end are left out."""
    joined = "\x02" + "\x02".join(f" {_NUMBER.sub('0', t.strip().lower())} " for t in texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(c == 2, dtype=np.int32) - 1
    c = c.astype(np.uint64)
    grams, owners = [np.array([_script(t) for t in texts], np.int64)], [np.arange(len(texts), dtype=np.int32)]
    h = np.zeros(len(c), np.uint64)
    inside = np.ones(len(c), bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = (h[:m] + c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        inside = inside[:m] & (c[n - 1 :] != 2)
        if n in ORDERS:
            grams.append(((h[inside] ^ (h[inside] >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) % (BUCKETS - SCRIPTS) + SCRIPTS)
            owners.append(owner[:m][inside])
    g, o = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return g[order], o[order]


def _logits(texts: list[str], model: Model) -> np.ndarray:
    g, o = _grams(texts)
    v = model.idf[g]
    at = np.searchsorted(o, np.arange(len(texts)))
    norm = np.sqrt(np.maximum(np.add.reduceat(v * v, at), 1e-12))
    out = np.empty((len(texts), len(LANGS)), np.float32)
    for k in range(len(LANGS)):
        out[:, k] = np.add.reduceat(model.weights[k][g] * v, at)
    return out / norm[:, None] + model.bias


def probabilities(texts: list[str], model: Model) -> np.ndarray:
    """Calibrated probabilities of the languages of each text."""
    out = []
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > 200_000 or i == len(texts) - 1:
            part = texts[start : i + 1]
            z = _logits(part, model) / model.temperature
            z -= z.max(1, keepdims=True)
            e = np.exp(z)
            out.append(e / e.sum(1, keepdims=True))
            start, size = i + 1, 0
    return np.concatenate(out) if out else np.empty((0, len(LANGS)), np.float32)


def _ftrl(g: np.ndarray, o: np.ndarray, y: np.ndarray, idf: np.ndarray, epochs: int, alpha: float = 0.6, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic-net penalties over mini-batches: weights (languages x BUCKETS) and bias."""
    k = len(LANGS)
    z, n = np.zeros((k, BUCKETS + 1)), np.zeros((k, BUCKETS + 1))
    v = idf[g]
    at = np.searchsorted(o, np.arange(len(y) + 1))
    rng = np.random.default_rng(7)

    def weight(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            ids = order[s : s + batch]
            spans = [np.arange(at[i], at[i + 1]) for i in ids]
            idx = np.concatenate(spans)
            rows = np.repeat(np.arange(len(ids)), [len(x) for x in spans])
            feats, inv = np.unique(g[idx], return_inverse=True)
            val = v[idx]
            norm = np.sqrt(np.maximum(np.bincount(rows, val * val, len(ids)), 1e-12))
            val = val / norm[rows]
            cols = np.append(feats, BUCKETS)
            w = weight(z[:, cols], n[:, cols])
            logits = np.stack([np.bincount(rows, w[c][inv] * val, len(ids)) + w[c][-1] for c in range(k)], 1)
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), y[ids]] -= 1
            for c in range(k):
                grad = np.append(np.bincount(inv, p[rows, c] * val, len(feats)), p[:, c].sum() / 10)
                sigma = (np.sqrt(n[c, cols] + grad * grad) - np.sqrt(n[c, cols])) / alpha
                z[c, cols] += grad - sigma * w[c]
                n[c, cols] += grad * grad
    w = weight(z, n).astype(np.float32)
    return w[:, :BUCKETS], w[:, BUCKETS]


def fit(texts: list[str], labels: list[int], groups: list[int], epochs: int = 3) -> Model:
    """Fit on labelled sentences. Labels are noisy by document, so two models are fitted first, each on half of the
    groups (documents); a sentence whose label the model of the other half contradicts is left out of the last fit."""
    y, half = np.array(labels), np.array(groups) % 2
    g, o = _grams(texts)
    seen = np.unique(o.astype(np.int64) * BUCKETS + g) % BUCKETS
    df = np.bincount(seen, minlength=BUCKETS)
    idf = np.where(df > 0, np.log((1 + len(texts)) / (1 + df)) + 1, 0).astype(np.float32)

    def fitted(use: np.ndarray) -> Model:
        keep = use[o]
        new = np.cumsum(use) - 1
        return Model(*_ftrl(g[keep], new[o[keep]], y[use], idf, epochs), idf, 1.0)

    good = np.ones(len(y), bool)
    if len(np.unique(half)) == 2:
        for k in (0, 1):
            judged = np.flatnonzero(half == k)
            p = probabilities([texts[i] for i in judged], fitted((half != k) | (np.array(groups) < 0)))
            good[judged] = (p[np.arange(len(judged)), y[judged]] > 0.3) | (np.array(groups)[judged] < 0)
    held = (np.random.default_rng(3).random(len(y)) < 0.1) & (np.array(groups) >= 0)
    model = fitted(good & ~held)
    if held.any():
        model.temperature, model.noise = _calibrate(_logits([t for t, h in zip(texts, held, strict=True) if h], model), y[held])
    return model


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature of greatest likelihood on held-out rows, all of them. Their labels are noisy, so the share of
    labels drawn at random is estimated along with it; otherwise wrong labels would pass for unsure predictions. From n
    rows no error below 1 / (n + 2) can be known, so that share of each row's weight lies on all languages alike: a
    model that is never wrong on them doesn't become certain."""
    best = (np.inf, 1.0, 0.0)
    unknown = 1 / (len(y) + 2)
    for t in np.geomspace(0.05, 5, 60):
        q = z / t - (z / t).max(1, keepdims=True)
        log = q - np.log(np.exp(q).sum(1, keepdims=True))
        p, spread_ = np.exp(log[np.arange(len(y)), y]), log.mean()
        for noise in (0.0, *np.geomspace(0.002, 0.5, 24)):
            nll = -(1 - unknown) * np.log((1 - noise) * p + noise / z.shape[1] + 1e-12).mean() - unknown * spread_
            best = min(best, (float(nll), float(t), float(noise)))
    return best[1], best[2]


def plain_table(spark: SparkSession) -> dict[int, str]:
    """The form table without the look-alikes between kana and Han, which tell languages apart here."""
    return {k: v for k, v in form_table(spark).items() if not (0x3040 <= k < 0x30A0 or 0x4E00 <= k < 0xA000)}


def train(documents: DataFrame) -> Model:
    """A model from the bounded sample: ``SAMPLE_DOCS`` labelled documents by hash, their sentences by script."""
    table = plain_table(documents.sparkSession)
    labelled = documents.select(label_language(F.col("lang")).alias("lang"), "text", F.xxhash64("doc_id").alias("h")).where("lang is not null and text is not null and length(text) > 0")
    # a cut of the hashes that leaves about the sample, so that what reaches the driver doesn't grow with the corpus
    share = min(1.0, 1.3 * SAMPLE_DOCS / max(1, labelled.count()))
    cut = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    rows = labelled.where(F.col("h") <= F.lit(cut)).orderBy("h").limit(SAMPLE_DOCS).select("lang", "text", "h").collect()
    texts, labels, groups = [], [], []
    seen = set()
    rng = np.random.default_rng(5)
    for n, r in enumerate(rows):
        own = [s for s in sentences(r["text"], table) if s not in seen]
        for s in [own[i] for i in rng.permutation(len(own))[:DOC_SENTENCES]]:
            seen.add(s)
            texts.append(s)
            labels.append(LANGS.index(r["lang"]))
            groups.append(n)
    # an equal bound for every language, so that a common one doesn't draw the others' sentences to itself
    pick = rng.permutation(len(texts))
    of = np.array(labels, int)[pick]
    pick = np.concatenate([pick[of == k][: SAMPLE_SENTENCES // len(LANGS)] for k in range(len(LANGS))]) if len(pick) else pick
    own = [(texts[i], labels[i], groups[i]) for i in pick] + [(s, LANGS.index(lang), -1) for s, lang in SEEDS]
    model = fit([x[0] for x in own], [x[1] for x in own], [x[2] for x in own])
    model.last = max((r["h"] for r in rows), default=model.last)
    return model


#: One plain sentence of each language, so that every class is known even to a model of an empty table.
SEEDS = [
    ("これは日本語の文です。", "ja"), ("This is a sentence in English and it has some words.", "en"), ("这是一个中文的句子。", "zh"), ("이것은 한국어 문장입니다.", "ko"),
    ("Ceci est une phrase en français avec des mots.", "fr"), ("Das ist ein Satz auf Deutsch und er hat Wörter.", "de"), ("Esta es una frase en español con algunas palabras.", "es"),
]


def runs(texts: list[str | None], model: Model, table: dict[int, str]) -> list[list[tuple[str, float]]]:
    """Of each text, its maximal runs of one language in reading order, each with its mean confidence."""
    cut = [sentences(t, table) if t else [] for t in texts]
    known: dict[str, int] = {}
    for ss in cut:
        for s in ss:
            known.setdefault(s, len(known))
    p = probabilities(list(known), model)
    lang, sure = p.argmax(1) if len(p) else [], p.max(1) if len(p) else []
    out = []
    for ss in cut:
        merged: list[list] = []
        for s in ss:
            i = known[s]
            if sure[i] < SURE and merged:
                continue
            if merged and merged[-1][0] == lang[i]:
                merged[-1][1].append(sure[i])
            else:
                merged.append([lang[i], [sure[i]]])
        out.append([(LANGS[k], float(np.mean(c))) for k, c in merged])
    return out


def segment(records: DataFrame, model: Model, mislabelled: bool = False) -> DataFrame:
    """``(record_kind, record_key, text, label)`` with normal labels -> one row per run: label, seg, lang, confidence.
    ``mislabelled`` keeps only records whose label doesn't name exactly the language of their only run."""
    spark = records.sparkSession
    sent = spark.sparkContext.broadcast((model, plain_table(spark)))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, table = sent.value
        for b in batches:
            for start in range(0, len(b), 2000):
                part = b.iloc[start : start + 2000]
                rows = []
                for kind, key, label, found in zip(part["record_kind"], part["record_key"], part["label"], runs(part["text"].tolist(), m, table), strict=True):
                    if not mislabelled or (found and not (len(found) == 1 and found[0][0] == label)):
                        rows += [(kind, key, label, i, lang, c) for i, (lang, c) in enumerate(found)]
                yield pd.DataFrame(rows, columns=["record_kind", "record_key", "label", "seg", "lang", "confidence"])

    return records.select("record_kind", "record_key", "text", "label").mapInPandas(step, "record_kind string, record_key string, label string, seg int, lang string, confidence double")


def records(documents: DataFrame, items: DataFrame | None, settings: DataFrame | None) -> DataFrame:
    """Documents and long_text items (if any) as records; an item's label is its game's source language."""
    docs = spread(documents.where("doc_id is not null").select("doc_id", "text", "lang")).select(F.lit("document").alias("record_kind"), F.col("doc_id").cast("string").alias("record_key"), "text", label_language(F.col("lang")).alias("label"))
    if items is None:
        return docs
    games = settings.groupBy("game_id").agg(F.first(label_language(F.col("source_language")), ignorenulls=True).alias("label"))
    texts = spread(items.where("item_type = 'long_text' and fact_id is not null").select("game_id", F.col("fact_id").alias("record_key"), F.array_join("original_lines", "\n").alias("text")))
    lines = texts.join(games, "game_id", "left").select(F.lit("item").alias("record_kind"), "record_key", "text", "label")
    return docs.unionByName(lines)


def confidence_error(documents: DataFrame, model: Model) -> DataFrame:
    """How far the confidence can be believed: labelled documents outside the training sample, each with one run, by
    twentieths of their confidence: their number, mean confidence, and the share whose label names the run's language
    (which wrong labels keep below the confidence). No rows where the sample took all documents."""
    held = documents.where(F.xxhash64("doc_id") > F.lit(model.last))
    one = segment(records(held, None, None), model).groupBy("record_key", "label").agg(F.count("*").alias("runs"), F.first("lang").alias("lang"), F.first("confidence").alias("confidence"))
    step = F.least(F.floor(F.col("confidence") * 20), F.lit(19)).cast("int")
    return one.where("runs = 1 and label is not null").groupBy(step.alias("twentieth")).agg(F.count("*").alias("documents"), F.avg("confidence").alias("confidence"), F.avg((F.col("label") == F.col("lang")).cast("int")).alias("agreed"))
