"""The llm operators against brute force, round trips and held-out accuracy, and their defined results in edge cases."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import codetext, conversations, forms, language, packing, pairs, queries, subjects, tokens

VOCABULARY = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
ITEM = "game_id long, fact_id string, location_path string, item_type string, role string, original_lines array<string>, source_line_paths array<string>, translation_lines array<string>, saved_at timestamp_ntz, loaded_at timestamp_ntz"


def _item(fact, path="Map001.json/1/0/0", kind="long_text", role="A", o=("x",), t=("译",), game=1, paths=None):
    import datetime as dt

    at = dt.datetime(2025, 1, 1)
    return (game, fact, path, kind, role, None if o is None else list(o), list(paths) if paths is not None else ["p"] * len(o or []), None if t is None else list(t), at, at)


# -- p4: forms


TEXTS = ["エマベス力ゴ", "Thе shір", "ドｾﾞエｳﾞェ", "が゙", "が", "éx", "ậ", "ậ", "한글", "", None, "⼀ａ​\xa0b", "́a", "x" * 30_000, "각", "ﾊﾟ", "ｶﾞ゙"]


def test_canonical_texts_equals_definition(spark):
    table = forms.form_table(spark)
    rng = random.Random(1)
    alphabet = "aẹ́́̂かガ゚へﾞｶﾊ각한 　​Ее一ー,，"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.form for r in forms.canonical_texts(df, ["k"]).collect()}
    assert got == {i: None if t is None else forms.fold(t, table) for i, t in enumerate(texts)}


def test_form_keeps_what_differs(spark):
    table = forms.form_table(spark)
    for a, b in [("A", "a"), ("e", "é"), ("カ", "ガ"), ("ツ", "ッ"), ("1", "2"), ("0", "O"), ("1", "l"), ("ハ", "パ"), ("n", "ñ")]:
        assert forms.fold(a, table) != forms.fold(b, table)
    for a, b in [("ＡＢ１", "AB1"), ("ｶﾞ", "ガ"), ("Аа", "Aa"), ("力", "カ"), ("a​b", "ab"), ("a　b", "a b"), ("⼈", "人")]:
        assert forms.fold(a, table) == forms.fold(b, table)


def test_control_codes_are_invisible(spark):
    texts = {r"\C[0]": False, r"\!\.": False, r"\n<Ab>": False, r"\V[1] ": False, r"\C[0]a": True, "C[0]": True, "": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in df.select("t", forms.visible(F.col("t")).alias("v")).collect()} == texts


def test_same_looking_pairs(spark):
    rows = [_item("a", o=["カ ab"], t=["x"]), _item("b", o=["力　ab"], t=["x"]), _item("b", o=["力　ab"], t=["x"]), _item("c", o=["カ", None], t=None), _item("d", o=["カ ab"]), _item("e", o=[]), _item("f", o=None), _item("g", o=["​"]), _item("h", o=["　"])]
    df = spark.createDataFrame(rows, ITEM).withColumn("form", F.lit(1)).withColumn("h", F.lit("clash"))
    got = sorted((r.field, r.fact_a, r.fact_b) for r in forms.same_looking_pairs(df, ["original_lines", "translation_lines"]).collect())
    assert got == [("original_lines", "a", "b"), ("original_lines", "b", "d")]
    assert forms.same_looking_pairs(df.limit(0), ["original_lines"]).count() == 0
    rows = forms.same_looking_classes(df, ["original_lines", "translation_lines"]).collect()
    assert sorted((r.field, r.fact_id, r.links) for r in rows) == [("original_lines", "a", 1), ("original_lines", "b", 2), ("original_lines", "d", 1)]
    assert len({r["class"] for r in rows}) == 1 and len({r.spelling for r in rows}) == 2
    # a text that most rows hold, beside one other spelling
    hot = spark.createDataFrame([_item(f"h{i}", o=["カ ab"], t=None) for i in range(300)] + [_item("x", o=["力 ab"], t=None)], ITEM)
    assert forms.same_looking_pairs(hot, ["original_lines"]).count() == 300
    assert {(r.links, r.n) for r in forms.same_looking_classes(hot, ["original_lines"]).groupBy("links").agg(F.count("*").alias("n")).collect()} == {(1, 300), (300, 1)}


# -- p2: conversations


def _brute(rows, table):
    import collections
    import re

    def seen(text):
        for code in (r"\C[0]", r"\n<Ab>", r"\!", r"\."):
            text = text.replace(code, "")
        return text.strip()

    convs = collections.defaultdict(dict)
    for r in rows:
        m = re.fullmatch(r"Map001\.json/(\d+)/(\d+)/(.*)", r[2])
        if m:
            convs[r[0], f"Map001.json/{m[1]}/{m[2]}"][r[1]] = (m[3], r)
    out = set()
    for (g, c), facts in convs.items():
        ms = [(int(p) if p.isascii() and p.isdigit() else None, f, r) for f, (p, r) in facts.items()]
        who = ["player" if r[3] == "array" else forms.fold(r[4] or "", table).strip() for _, _, r in ms]
        ok = all(p is not None and w and seen(forms.fold("".join(x for x in r[5] or [] if x), table)) and (r[3] != "long_text" or len(r[5]) == len(r[6])) for (p, _, r), w in zip(ms, who, strict=True))
        if ok and len({p for p, _, _ in ms}) == len(ms) and len(set(who) - {"旁白"}) > 1:
            out |= {(g, c, i, f) for i, (_, f, _) in enumerate(sorted(ms))}
    return out


def test_conversations_equal_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for g in (1, 2):
        for e in range(12):
            for p in range(rng.randint(1, 6)):
                pos = rng.choice([str(p)] * 12 + ["x", "", f"0{p}", "-1"])
                r = _item(f"f{g}-{e}-{p}", f"Map001.json/{e}/0/{pos}", rng.choice(["long_text"] * 5 + ["array"]), rng.choice(["A", "B", "Ａ", "B​", "旁白", "A "] * 4 + [None, " "]), rng.choice([["hi"], ["\\C[0]hi"]] * 9 + [[" "], [], ["\\C[0]"], ["\\!\\.", "\\n<Ab>"]]), game=g, paths=rng.choice([["p"]] * 15 + [["p", "q"]]))
                rows += [r] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    path = f"{tmp_path}/items.parquet"
    spark.createDataFrame(rows, ITEM).withColumn("conv", F.lit("clash")).withColumn("pos", F.lit(1)).write.parquet(path)
    for batch in (None, 1):  # in one micro-batch, and a file at a time
        got = {(r.game_id, r.conv, r.turn, r.fact_id) for r in conversations.assemble_backlog(spark, path, batch).collect()}
        assert got == _brute(rows, forms.form_table(spark)) and got


def test_backlog_takes_files_of_any_time(spark, tmp_path):
    import datetime as dt

    def said(fact, pos, role, year):
        r = list(_item(fact, f"Map001.json/1/0/{pos}", role=role))
        r[-2:] = [None if year is None else dt.datetime(year, 1, 1)] * 2
        return tuple(r)

    # decades apart, newest first, and without any time
    path = f"{tmp_path}/items.parquet"
    for r in (said("a", 0, "A", 2199), said("b", 1, "B", 1971), said("c", 2, "A", None), said("d", 3, "B", 2030)):
        spark.createDataFrame([r], ITEM).coalesce(1).write.mode("append").parquet(path)
    assert [(r.turn, r.fact_id) for r in conversations.assemble_backlog(spark, path, 1).orderBy("turn").collect()] == list(enumerate("abcd"))
    undated = f"{tmp_path}/undated.parquet"
    spark.createDataFrame([said("a", 0, "A", None), said("b", 1, "B", None)], ITEM).write.parquet(undated)
    assert conversations.assemble_backlog(spark, undated).count() == 2


def test_late_messages_join_their_conversation(spark, tmp_path):
    import datetime as dt
    import os
    import time

    t0 = dt.datetime(2025, 1, 1)
    kind = "game_id long, conv string, fact_id string, pos long, speaker string, sound boolean, at timestamp"
    files = [
        [(1, "X", "x0", 0, "A", True, t0), (1, "X", "x2", 2, "A", True, t0 + dt.timedelta(hours=1)), (1, "Y", "y0", 0, "A", True, t0)],
        [(1, "X", "x1", 1, "B", True, t0 + dt.timedelta(minutes=30))],
        [(1, "Z", "z0", 0, "A", True, t0 + dt.timedelta(days=9)), (1, "Z", "z1", 1, "B", True, t0 + dt.timedelta(days=9))],
    ]
    source = tmp_path / "in"
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
        for f in source.glob("*.parquet"):
            if not f.name.startswith("batch"):
                f.rename(source / f"batch{n}.parquet")
                os.utime(source / f"batch{n}.parquet", (time.time() + n, time.time() + n))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = conversations.assemble(stream, "1 day", "2 days").writeStream.outputMode("append").format("memory").queryName("talks").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    # X is closed by the watermark with its late message; Y has one speaker; Z is still open
    assert [(r.conv, r.turn, r.fact_id) for r in spark.table("talks").orderBy("turn").collect()] == [("X", 0, "x0"), ("X", 1, "x1"), ("X", 2, "x2")]


def test_conversation_paths_and_names(spark):
    rows = [
        _item("a", "www/data\\map012.json\\3\\0\\1", role=None, o=["【Ｋai】", "x"]), _item("b", "Map012.json//3/0/2", role="", o=["\\C[1]\\n<Mo>hi"]), _item("c", "CommonEvents.json/7/4", role=" ", o=["Ned「hi」"]),
        _item("d", "Map001.json/4/note/desc"), _item("e", "troops.json/1/0/3", role=None, o=["no name here"]), _item("f", "Map001.json/displayName"), _item("g", None),
    ]
    got = {r.fact_id: (r.conv, r.pos, r.speaker) for r in conversations.message_rows(spark.createDataFrame(rows, ITEM)).collect()}
    assert got == {"a": ("Map012.json/3/0", 1, "Kai"), "b": ("Map012.json/3/0", 2, "Mo"), "c": ("CommonEvents.json/7", 4, "Ned"), "e": ("Troops.json/1/0", 3, None)}


def test_conversations_of_empty_table(spark, tmp_path):
    path = f"{tmp_path}/none.parquet"
    spark.createDataFrame([], ITEM).write.parquet(path)
    assert conversations.assemble_backlog(spark, path).count() == 0


# -- p3: pairs


@pytest.mark.parametrize(
    ("o", "t", "kind", "want"),
    [
        ("さっきの声だ。", "", "long_text", "empty"), ("さっきの声だ。", "​\n", "long_text", "empty"), ("さっきの声だ。", "抱歉，我无法翻译这段内容。", "long_text", "refusal"),
        ("When the rain stops.", "I'm sorry, but I can't translate this text.", "long_text", "refusal"), ("行こう。", "번역할 수 없습니다.", "long_text", "refusal"), ("行こう。", "Je ne peux pas traduire ce texte.", "long_text", "refusal"),
        ("行こう。", "Ich kann diesen Text leider nicht übersetzen.", "long_text", "refusal"), ("行こう。", "No puedo traducir este texto.", "long_text", "refusal"),
        ("I am sorry, Ema, but I cannot help you with that.", "抱歉，艾玛，这件事我帮不了你。", "long_text", None), ("雨がやんだら、行こう。", "译文：雨がやんだら、行こう！", "long_text", "copy"), ("Old Map of Suze", "OLD MAP OF SUZE", "short_text", "copy"),
        ("HP", "HP", "short_text", None), ("\\V[65]", "\\V[65]", "short_text", None), ("雨がやんだら、行こう。", "When the rain stops, let us go.", "long_text", "wrong_language"), ("When the rain stops, let us go.", "雨がやんだら、行こう。", "long_text", "wrong_language"),
        ("雨がやんだら、行こう。", "雨停了我们就\\C[", "long_text", "truncated"), ("雨がやんだら、行こう。", "雨停了我们…", "long_text", "truncated"), ("雨がやんだら。\n行こう。", "雨停了。", "long_text", "truncated"), ("「行こう。」", "「走吧。", "long_text", "truncated"),
        ("雨がやんだら。\n行こう。", "雨停了。走吧。", "long_text", None), ("\\!", "", "long_text", None), (None, None, None, None), ("…", "…", "short_text", None),
    ],
)
def test_pair_rules(o, t, kind, want):
    found, _ = pairs.judge(o or "", t or "", kind)
    assert (found[0] if found else None) == want


def test_every_triggered_type_is_emitted():
    assert pairs.judge("雨がやんだら。\n行こう。", "抱歉，我无法翻译这段内容", "long_text")[0] == ["refusal", "truncated"]
    assert pairs.judge("行こう。", "번역할 수 없습니다.", "long_text")[0] == ["refusal", "wrong_language"]
    assert pairs.judge("雨がやんだら、北の塔へ向かおう。", "雨がやんだら、北の塔へ向かおう。", "long_text")[0] == ["copy", "wrong_language"]
    # a heading and a closing of any length, as long as the original is the greater part
    long = "雨がやんだら、北の塔へ向かおう。" * 4
    assert "copy" in pairs.judge(long, f"以下是按照要求给出的这一段话的完整译文内容请您查收一下{long}", "long_text")[0]


def test_abrupt_endings_are_learned(spark):
    full = ["雨停了我们就去北边的塔吧。", "好像有人在桥的另一边等着。", "请把这段旋律演奏得再慢一些。"]
    rows = [_item(f"n{i}", o=["雨がやんだら。"], t=[full[i % 3]]) for i in range(30)]
    rows += [_item("whole", o=["雨がやんだら。"], t=["雨停了我们就去北边的塔吧"]), _item("cut", o=["雨がやんだら。"], t=["雨停了我们就去北"]), _item("cut", o=["雨がやんだら。"], t=["雨停了我们就去北"]), _item("unknown", o=["雨がやんだら。"], t=["龙鳞闪耀金光"]), _item("e", o=["行こう。"], t=None), _item("z", o=None, t=None)]
    df = spark.createDataFrame(rows, ITEM).withColumn("defects", F.lit("clash")).withColumn("tail", F.lit(1))
    got = {r.fact_id: r.defect for r in pairs.first_defect(pairs.defects(df)).collect()}
    assert got == {"cut": "truncated", "e": "empty"}
    assert pairs.defects(df.limit(0)).count() == 0


# -- p1: language

SAMPLES = {
    "ja": ["雨がやんだら、北の塔へ向かおう。", "この扉は鍵でしか開かないんだ。", "昔、ここには何もなかったそうだ。"], "en": ["When the rain stops, let us head for the tower.", "This door only opens with a key.", "There was nothing here long ago."],
    "zh": ["雨停了我们就去北边的塔吧。", "这扇门只有钥匙才能打开。", "听说很久以前这里什么都没有。"], "ko": ["비가 그치면 북쪽 탑으로 가자.", "이 문은 열쇠로만 열린다고.", "옛날 여기에는 아무것도 없었다."],
    "fr": ["Quand la pluie cessera, nous irons vers la tour.", "Cette porte ne s'ouvre qu'avec la clé.", "On dit qu'il n'y avait rien ici."], "de": ["Wenn der Regen aufhört, gehen wir zum Turm.", "Diese Tür lässt sich nur mit dem Schlüssel öffnen.", "Man sagt, dass hier früher nichts war."],
    "es": ["Cuando pare la lluvia, iremos hacia la torre.", "Esta puerta solo se abre con la llave.", "Dicen que antes aquí no había nada."],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    words = {k: [w for s in v for w in s.rstrip(".。").split(" ")] for k, v in SAMPLES.items()}
    texts, labels, groups = [], [], []
    for i in range(700):
        lang = language.LANGS[i % 7]
        s = rng.choice(SAMPLES[lang]) if rng.random() < 0.6 else " ".join(rng.choices(words[lang], k=5))
        texts.append(s)
        labels.append(language.LANGS.index(lang if rng.random() > 0.05 else rng.choice(language.LANGS)))
        groups.append(i)
    return language.fit(texts, labels, groups, epochs=2)


def test_language_accuracy_and_calibration(model):
    texts = [s for v in SAMPLES.values() for s in v]
    p = language.probabilities(texts, model)
    assert [language.LANGS[i] for i in p.argmax(1)] == [k for k, v in SAMPLES.items() for _ in v]
    assert np.allclose(p.sum(1), 1) and 0 < model.temperature <= 5 and (model.weights == 0).mean() > 0.5


def test_temperature_is_fitted_despite_wrong_labels():
    rng = np.random.default_rng(8)
    z = rng.normal(size=(20_000, 7)) * 2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(7, p=x) for x in p])
    wrong = rng.random(len(y)) < 0.15
    y[wrong] = rng.integers(0, 7, wrong.sum())
    t, noise = language._calibrate(3 * z, y)  # logits three times too sure
    assert abs(t - 3) < 0.4 and abs(noise - 0.15) < 0.07


def test_a_model_without_errors_is_not_certain():
    z = np.full((500, 7), -4.0)
    y = np.arange(500) % 7
    z[np.arange(500), y] = 4.0
    t, noise = language._calibrate(z, y)
    p = 1 / (1 + 6 * np.exp(-8 / t))
    assert 0.99 < p < 1 - 1e-4 and noise < 0.01


def test_japanese_in_han_alone_and_korean_are_decided_by_the_model():
    texts = ["第一章開始", "第二章終了", "第三章準備"] * 300 + ["第一章开始", "第二章结束", "第三章准备"] * 300 + ["비가 그치면", "문은 열린다고"] * 300
    labels = [0] * 900 + [2] * 900 + [3] * 600
    m = language.fit(texts, labels, [i // 6 for i in range(2400)], epochs=3)
    assert [language.LANGS[i] for i in language.probabilities(["第一章開始", "第二章结束", "문은 그치면"], m).argmax(1)] == ["ja", "zh", "ko"]


def test_confidence_error(model, spark):
    rows = [(i, SAMPLES["ja" if i % 2 else "en"][i % 3], "ja" if i % 2 or i < 10 else "en") for i in range(100)] + [(200, None, "ja"), (201, SAMPLES["ja"][0], None), (202, SAMPLES["ja"][0] + SAMPLES["ko"][0], "ja")]
    got = language.confidence_error(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert sum(r.documents for r in got) == 100 and round(sum(r.agreed * r.documents for r in got)) == 95
    assert all(r.twentieth / 20 <= r.confidence <= (r.twentieth + 1) / 20 + 1e-6 for r in got)


def test_language_runs(model, spark):
    t = language.plain_table(spark)
    text = "ネハ: 雨がやんだら、北の塔へ向かおう。 (3/7)\\C[1]この扉は鍵でしか開かないんだ。\nThis door only opens with a key. 0x7F data/Map001.json HP 12\nネハ\nThere was nothing here long ago."
    assert [k for k, _ in language.runs([text], model, t)[0]] == ["ja", "en"]
    none = ["", None, "　", "12345", "☆★☆", "%1 / %2", "HP", "\\C[0]\\!", "ネハ", "img/a/b.png", "Map001.json"]
    assert language.runs(none, model, t) == [[] for _ in none]
    assert [k for k, _ in language.runs(["雨がやんだら、北の塔へ向かおう。" * 3000], model, t)[0]] == ["ja"]


def test_language_cases(model, spark):
    rows = [("document", "1", SAMPLES["ja"][0], "ja"), ("document", "2", SAMPLES["ja"][0], None), ("document", "2", SAMPLES["ja"][0], None), ("document", "3", None, None), ("document", "4", SAMPLES["en"][0] + "\n" + SAMPLES["ko"][0], "en"), ("item", "5", SAMPLES["fr"][0], "de")]
    df = spark.createDataFrame(rows, "record_kind string, record_key string, text string, label string").withColumn("seg", F.lit("clash"))
    got = sorted({(r.record_key, r.seg, r.lang) for r in language.segment(df, model, mislabelled=True).collect()})
    assert got == [("2", 0, "ja"), ("4", 0, "en"), ("4", 1, "ko"), ("5", 0, "fr")]
    assert language.segment(df.limit(0), model).count() == 0


def test_label_spellings(spark):
    df = spark.createDataFrame([(x,) for x in ["ja-JP", " JA", "jpn", "Japanese", "ja_jp", "zh_Hans_CN", "auto", "", None, "n/a", "it", "fra"]], "l string")
    assert [r[0] for r in df.select(language.label_language(F.col("l"))).collect()] == ["ja"] * 5 + ["zh"] + [None] * 5 + ["fr"]


# -- p5: language in code


def test_natural_spans(spark):
    src = "// If you are tired, rest here for a while.\r\nvar a = 'use strict', b = /'x'/g;\nf(\"\\u96e8\\u304c\\u3084\\u3093\\u3060\\u3089\\u3001\\u884c\\u3053\\u3046\\u3002\"); /* this.refresh(); */\n/*:\n * @param x\n * @plugindesc Si encuentras la llave, avisa enseguida a Bemi.\n */ c(`Ich habe ${k + '}'} nichts davon gewusst.`, 'a,b,c,7', 'img/a b/c.png', '#ff54a0', '𝔘雨停了我们就去北边的塔吧。');"
    rows = [(1, src), (1, src), (2, None), (3, ""), (4, "'" + "雨がやんだら、行こう。" * 2000)]
    df = spark.createDataFrame(rows, "file_id long, source_text string").withColumn("loaded_at", F.current_timestamp()).withColumn("lang", F.lit("clash"))
    got = {(r.file_id, r.lang): r for r in codetext.natural_spans(df).collect()}
    assert set(got) == {(1, "en"), (1, "ja"), (1, "es"), (1, "de"), (1, "zh"), (4, "ja")}
    assert got[1, "en"].start_index == 0 and src[got[1, "ja"].start_index] == '"' and src[got[1, "zh"].start_index] == "'" and src[got[1, "de"].start_index] == "`"
    share = {r.lang: r.share for r in codetext.shares(codetext.natural_spans(df)).where("file_id = 4").collect()}
    assert share == {"ja": 1.0}
    assert codetext.natural_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("code", ["if (flag) { return null; }", "use strict", "for (let i = 0; i < 3; i++) {", "eslint-disable-next-line no-undef", "a,b,c,17", "item.id > 45 && !done", "rgba(1,2,3,0.5)", "@ts-ignore", "max-items-3", "#region x"])
def test_code_is_no_language(code):
    assert codetext.language(code) is None


def test_two_words_are_a_phrase():
    assert codetext.language("the sword") == "en" and codetext.language("the") is None and codetext.language("a,b,c,7") is None


def test_votes_need_word_boundaries():
    assert sum(codetext.votes("otherness_of thesis").values()) == 0
    assert codetext.votes("The house and the garden")["en"] > 2


# -- p6: tokens


def _reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "<|endoftext|>"), (-4, "a" * 70_000), (-5, " \t\n x\x1cy\x85 "), (-6, "I'LL don't"), (-6, "I'LL don't"), (-7, "日本" * 9000)], docs.schema)
    docs = docs.unionByName(more).withColumn("ids", F.lit("clash"))
    rows = docs.collect()
    got = sorted((r.doc_id, r.ids) for r in tokens.encode(docs, tokens.build_lexicon(docs, size=500)).collect())
    assert got == sorted(zip([r.doc_id for r in rows], _reference([r.text for r in rows]), strict=True))
    assert dict(got)[-1] == [] and dict(got)[-2] == []
    counts = {r.doc_id: r.tokens for r in tokens.token_counts(docs, tokens.build_lexicon(docs, size=5)).collect()}
    assert counts == {k: len(v) for k, v in got}


def test_transducer_is_minimal_and_exact():
    words = sorted({w.encode() for w in "a ab abc bc c xbc xc ybc yc zz".split()})
    entries = [(w, [i, i + 1]) for i, w in enumerate(words)]
    lex = tokens.Lexicon(tokens.Lexicon.pack(tokens.compile_lexicon(entries)))
    assert lex.numbers(words).tolist() == list(range(len(words)))
    assert lex.numbers([b"", b"x", b"abcd", b"q", b"b"]).tolist() == [-1] * 5
    # states by brute force: distinct right languages of prefixes
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    assert len(lex.final) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})
    none = tokens.Lexicon(tokens.Lexicon.pack(tokens.compile_lexicon([])))
    assert none.numbers([b"a"]).tolist() == [-1]


def test_ids_of_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode(df, tokens.build_lexicon(df)).count() == 0


# -- p7: packing


@pytest.mark.parametrize("pack", [packing.by_patterns, packing.harmonic])
def test_packing_is_whole_and_fits(pack, spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 5, 17, 40, 64, 65, 100, 128, 129, 500]) if rng.random() < 0.7 else 33 for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long").withColumn("rank", F.lit("clash"))
    budgets = spark.createDataFrame([(1, 64), (2, 128)], "budget_id int, capacity_tokens int")
    rows = pack(df.select("doc_id", "tokens"), budgets).collect()
    for b, c in ((1, 64), (2, 128)):
        own = [r for r in rows if r.budget_id == b]
        by_doc, by_bin = {}, {}
        for r in own:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_bin[r.container] = by_bin.get(r.container, 0) + r.tokens
        assert set(by_doc) == set(range(400)) and max(by_bin.values()) <= c
        for d, parts in by_doc.items():
            assert sum(p.tokens for p in parts) == sizes[d] and sorted(p.piece for p in parts) == list(range(parts[0].pieces))
            assert parts[0].pieces == max(1, -(-sizes[d] // c))
    if pack is packing.by_patterns:  # no more containers than first-fit decreasing needs
        for b, c in ((1, 64), (2, 128)):
            bins = []
            for size in sorted((r.tokens for r in rows if r.budget_id == b), reverse=True):
                k = next((i for i, room in enumerate(bins) if room >= size), None)
                if k is None:
                    bins.append(c - size)
                else:
                    bins[k] -= size
            assert len({r.container for r in rows if r.budget_id == b}) <= len(bins) + 1


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(30):
        counts = {s: rng.randint(1, 9) for s in rng.sample(range(1, 50), 12)}
        segments, bins = packing.plan(counts, 50)
        load = [0] * bins
        for size, _, first, per, number in segments:
            for b in range(first, first + number):
                load[b] += size * per
        assert sum(load) == sum(s * n for s, n in counts.items()) and max(load) <= 50
        for s, n in counts.items():
            own = [x for x in segments if x[0] == s]
            assert sum(x[3] * x[4] for x in own) == n and [x[1] for x in own] == sorted(x[1] for x in own)


def test_packing_repeated_ids(spark):
    df = spark.createDataFrame([(7, 200), (7, 200), (7, 64), (7, 64), (7, 3)], "doc_id long, tokens long")
    budgets = spark.createDataFrame([(1, 64)], "budget_id int, capacity_tokens int")
    for pack in (packing.by_patterns, packing.harmonic):
        used = pack(df, budgets).groupBy("container").agg(F.sum("tokens").alias("n")).collect()
        assert sum(r.n for r in used) == 531 and max(r.n for r in used) <= 64


def test_packing_of_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    budgets = spark.createDataFrame([(1, 64)], "budget_id int, capacity_tokens int")
    assert packing.by_patterns(df, budgets).count() == 0 and packing.harmonic(df, budgets).count() == 0


# -- p8: subjects


def test_subjects(spark):
    rng = random.Random(6)
    terms = {1: ["telescope", "magnet", "hypothesis", "laboratory"], 2: ["courtroom", "verdict", "lawyer", "contract"], 3: ["goalkeeper", "stadium", "referee", "penalty"]}
    plain = ["The rain will stop before the evening comes.", "Nobody knows the old road to the village.", "She waited at the bridge for a while.", "We should rest here until tomorrow morning."]
    docs, truth, labels = [], {}, []
    for d in range(240):
        own = rng.sample([1, 2, 3], rng.choice([0, 1, 1, 1, 2]))
        said = [f"The {a} stood beside the {b} number {rng.randint(1, 99)}." for s in own for a, b in [rng.sample(terms[s], 2) for _ in range(4)]]
        said += [rng.choice(plain) for _ in range(4)]
        rng.shuffle(said)
        docs.append((d, " ".join(said)))
        truth[d] = set(own)
        if d % 4 == 0:
            labels += [(d, s if rng.random() > 0.05 else 3) for s in own]
    docs += [(1000, None), (1001, ""), (1002, "HP 12"), (1003, docs[0][1] * 50)]
    truth |= {1000: set(), 1001: set(), 1002: set(), 1003: truth[0]}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("share", F.lit("clash"))
    lab = spark.createDataFrame(labels + labels[:5] + [(None, 1), (5, None), (99999, 2)], "doc_id long, subject_id int")
    areas = spark.createDataFrame([(1,), (2,), (3,)], "subject_id int")
    got = {}
    for r in subjects.subjects(df, lab, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_id)
    right = sum(got.get(d, set()) == s for d, s in truth.items())
    assert right / len(truth) > 0.97
    assert not any(got.get(d) for d in (1000, 1001, 1002))
    assert subjects.subjects(df, lab.limit(0), areas).count() == 0
    assert subjects.subjects(df.limit(0), lab, areas).count() == 0


def _about(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject_id)
    return got


def test_subjects_clamps_trusted_seeds(spark):
    # too few documents hold the phrases of subject 1 for a link of the later rounds
    docs = [(1, "Alembic boiled slowly. Rain stopped early."), (2, "Alembic cooled again. Nobody knows why.")]
    docs += [(10 + i, f"Verdict pleased lawyer {i}. Lawyer praised verdict.") for i in range(20)]
    # documents that speak of subject 2 throughout bear its seed out; the label 1 of the last is contradicted
    labels = [(1, 1), (2, 1)] + [(10 + i, 2) for i in range(8)] + [(29, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    areas = spark.createDataFrame([(1,), (2,)], "subject_id int")
    got = _about(subjects.subjects(df, spark.createDataFrame(labels, "doc_id long, subject_id int"), areas))
    assert got[1] == {1} and got[2] == {1}
    assert got[29] == {2}


def test_seeds_are_clamped_while_labels_spread(spark):
    # a chain 1-2-3-4 of similar documents, and one (5) labelled 2 among neighbours of 1
    links = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 4, 0.5), (5, 1, 0.5), (5, 2, 0.5)], "doc_id long, centre long, sim double")
    seeds = spark.createDataFrame([(1, [1]), (2, [1, 2]), (5, [3]), (9, [1])], "doc_id long, seeds array<int>")
    about, trusted = subjects.spread_labels(links, seeds, [1, 2, 3])
    # the seed of 5 is contradicted, that of 9 has no neighbour to bear it out; both subjects of 2 are kept and reach 4
    assert {r.doc_id: r.seeds for r in trusted.collect()} == {1: [1], 2: [1]}
    got = {r.doc_id: r.about for r in about.collect()}
    assert got[1] == [1] and got[4] == [1] and 1 in got[5] and 3 not in got[5] and 9 not in got


def test_graph_is_verified_and_bounded(spark):
    rng = random.Random(9)
    own = {d: sorted({rng.randrange(g * 100, g * 100 + 30) for _ in range(12)}) for g in range(6) for d in range(g * 60, g * 60 + 60)}
    own |= {d: [9001, 9002, 9003] for d in range(1000, 1700)}  # a group of the same phrases, larger than a star
    own |= {5000: [], 5001: [42_000_000]}
    cut = spark.createDataFrame([(d, b"x", [1] if d % 10 == 0 else [], [{"n": 1, "phrases": [subjects._hash(str(p)) for p in ps]}] if ps else []) for d, ps in own.items()], "doc_id long, same binary, seeds array<int>, sentences array<struct<n:int,phrases:array<long>>>")
    every = np.ones(subjects.BUCKETS, bool)
    texts = subjects._described(cut, (every, every)).cache()
    assert {r.doc_id: sorted(r.core) for r in texts.collect()} == {d: sorted(subjects._hash(str(p)) & (2**31 - 1) for p in ps) for d, ps in own.items()}
    links = subjects.graph(texts).collect()
    degree, near = {}, {d: {d} for d in own}
    for r in links:
        a, b = set(own[r.doc_id]), set(own[r.centre])
        assert abs(r.sim - len(a & b) / len(a | b)) < 1e-9 and r.sim >= subjects.SIMILAR
        near[r.doc_id].add(r.centre)
        near[r.centre].add(r.doc_id)
        degree[r.centre] = degree.get(r.centre, 0) + 1
    assert len(links) <= subjects.HASHES * len(own) and max(degree.values()) <= 2 * subjects.STAR * subjects.HASHES
    # pairs of an exact run that the graph joins within two links
    pairs_ = [(a, b) for a in range(360) for b in range(a) if len(set(own[a]) & set(own[b])) / len(set(own[a]) | set(own[b])) >= 0.5]
    assert pairs_ and sum(bool(near[a] & near[b]) for a, b in pairs_) / len(pairs_) > 0.85
    assert 5000 not in degree and near[5001] == {5001}


def test_subjects_counts_copies_once_and_leaves_ties(spark):
    docs = [(i, f"Telescope magnet {w}. Magnet telescope again.") for i, w in enumerate("red blue green black white brown".split())]
    docs += [(20 + i, f"Verdict lawyer {w}. Lawyer verdict again.") for i, w in enumerate("one two three four five six".split())]
    # copies of a text with both subjects: what only they hold is no evidence for either
    docs += [(100 + i, "Telescope quixotic magnet. Verdict zanzibar lawyer.") for i in range(40)]
    labels = [(i, 1) for i in range(6)] + [(20 + i, 2) for i in range(6)] + [(100 + i, s) for i in range(5) for s in (1, 2)]
    areas = spark.createDataFrame([(1,), (2,)], "subject_id int")
    got = _about(subjects.subjects(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject_id int"), areas))
    assert all(got[d] == {1, 2} for d in range(100, 140))
    assert got[0] == {1} and got[20] == {2}
    texts = spark.createDataFrame([(1, [7, 8]), (2, [7, 8]), (3, [7, 8]), (4, [8])], "doc_id long, phrases array<long>")
    about = spark.createDataFrame([(d, [1, 2]) for d in (1, 2, 3)] + [(4, [2])], "doc_id long, about array<int>")
    assert [(r.phrase, r.link & (2**31 - 1)) for r in subjects._links(subjects._phrase_counts(texts, about)).collect()] == [(8, 2)]


# -- the queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(name, spark, sf):
    df = queries.queries()[name](spark, sf)
    want = {"p1_found": ["record_kind", "record_key", "seg", "lang"], "p2_found": ["game_id", "conv", "turn", "fact_id"], "p3_found": ["fact_id", "defect"], "p4_found": ["field", "fact_a", "fact_b"], "p5_found": ["file_id", "start_index", "lang"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "subject_id"]}
    assert df.columns == want.get(name, df.columns)
    rows = df.collect()
    if name != "p6_ids":
        assert len({str(r) for r in rows}) == len(rows)
    if name == "p1_found":
        assert dict(df.dtypes) == {"record_kind": "string", "record_key": "string", "seg": "int", "lang": "string"}
    assert isinstance(df.schema, T.StructType) and unicodedata.unidata_version
