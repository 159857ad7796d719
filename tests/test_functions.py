"""Functions and operators on small fixtures, against expectations and invariants."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import controls, javascript, layout, namebox
from tessera.functions import json as J
from tessera.functions import text as X
from tessera.operators import scope, sequence, terminology, terms
from tessera.plans import projects, textual
from tessera.plans import relations as R
from tessera.rules import validate
from tessera.sources import files
from tessera.streaming import runs

MESSAGE = st.text(alphabet="ab\\VC[1]{}.!|%あ漢 N<>", max_size=30)


@settings(max_examples=200, deadline=None)
@given(MESSAGE)
def test_mask_then_restore_is_identity(t):
    masked, known = controls.mask(t)
    assert controls.restore(masked, known) == t


@settings(max_examples=200, deadline=None)
@given(MESSAGE)
def test_selected_spans_never_overlap(t):
    s = controls.all_spans(t)
    assert all(a[1] <= b[0] for a, b in zip(s, s[1:], strict=False))


def test_custom_and_paired_spans():
    m, known = controls.mask("<b>x</b> @1 @2 @1", custom=[(r"@\d", "AT")], paired=[(r"<b>(?P<text>.*?)</b>", "BOLD")])
    assert m == "[CUSTOM_BOLD_1]x[CUSTOM_BOLD_2] [CUSTOM_AT_1] [CUSTOM_AT_2] [CUSTOM_AT_1]"
    assert controls.restore(m.lower(), known) == "<b>x</b> @1 @2 @1"


def test_verify_placeholders():
    assert controls.verify("[RMMZ_WAIT_SHORT] a", "[RMMZ_WAIT_SHORT] b") == []
    assert controls.verify("[RMMZ_WAIT_SHORT]", "x") == ["number:[RMMZ_WAIT_SHORT]"]
    assert controls.verify("x", "[RMMZ_ICON_1]") == ["unknown:[RMMZ_ICON_1]"]
    # more line breaks than the original has are allowed, fewer are not; controls without a rule must stay
    two = controls.LINE_BREAK * 2
    assert controls.verify(controls.LINE_BREAK, two) == [] and controls.verify(two, controls.LINE_BREAK) == [f"number:{controls.LINE_BREAK}"]
    assert controls.verify("\\XX[1] a", "b") == ["other_controls"] and controls.verify("\\XX[1] a", "b \\XX[1]") == []


def test_spelled_out_escapes_and_prefixes():
    names = lambda t: [x[2] for x in controls.all_spans(t)]
    assert names(r"a\n b\"c") == [controls.LINE_BREAK, "[RMMZ_LITERAL_DOUBLE_QUOTE]"]
    assert names(r"\u3042\x41\101") == ["[RMMZ_LITERAL_UNICODE_ESCAPE_5C7533303432]", "[RMMZ_LITERAL_HEX_ESCAPE_5C783431]", "[RMMZ_LITERAL_OCTAL_ESCAPE_5C313031]"]
    assert names(r"\g \G[1]") == ["[RMMZ_CURRENCY_UNIT]"]
    # what only begins a longer control is none
    assert names(r"\nAme \FSx[2]") == [] and [r"\nAme"] == [r"\nAme x"[a:b] for a, b in controls.raw_candidates(r"\nAme x")]


def test_paired_rules_check_their_groups():
    rule = (r"(?P<a><b>)(?P<t>.*?)(?P<z></b>)", "t", {"a": "OPEN", "z": "CLOSE"})
    assert [x[2] for x in controls.paired_spans("x<b>hi</b>", [rule])] == ["[CUSTOM_OPEN_", "[CUSTOM_CLOSE_"]
    for bad in ((r"(?P<a>x?)(?P<t>b)", "t", {"a": "A"}), (r"(?P<t>(?P<a>b))", "t", {"a": "A"}), (r"(?P<t>b)|(?P<a>c)", "t", {"a": "A"})):
        with pytest.raises(controls.RuleError):
            controls.paired_spans("b", [bad])


def test_javascript_spans():
    src = "var a = /'\\/[/\"]/g; // it's\nb = 'x\\'y' + `t${f('z') + `u`}w` / 2; /* \"no\" */ c = \"//\";"
    got = [(src[a:b], k) for a, b, k in javascript.spans(src)]
    assert got == [("// it's", "line"), ("'x\\'y'", "str"), ("`t${f('z') + `u`}w`", "tpl"), ('/* "no" */', "block"), ('"//"', "str")]
    assert [k for _, _, k in javascript.spans("/* open")] == ["block"]
    assert [src2[a:b] for src2 in ["x = 'open\ny = \"z\""] for a, b, _ in javascript.spans(src2)] == ["'open", '"z"']


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 or c in "  " for c in s)), st.sampled_from("'\"`"))
def test_escape_round_trip(t, q):
    assert javascript.unescape(javascript.escape(t, q)) == t
    src = f"a = {q}{javascript.escape(t, q)}{q};"
    (a, b, _), *rest = javascript.spans(src)
    assert (a, b) == (4, len(src) - 1) and not rest


def test_spliced_sources_are_read_again():
    src = "a('x'); b(\"y\"); c('open"
    lit = [(a, b, src[a + 1 : b - (src[b - 1] == src[a] and b - a > 1)]) for a, b, k in javascript.spans(src) if k == "str"]
    assert [x[2] for x in lit] == ["x", "y", "open"]
    text, places, failure = javascript.spliced(src, [(*lit[0], "it's"), (*lit[1], "z"), (*lit[2], "shut")])
    assert failure is None and text == "a('it\\'s'); b(\"z\"); c('shut" and [text[p] for p, _ in places] == ["'", '"', "'"]
    assert javascript.spliced(src, [(2, 5, "other", "z")])[2] == "source_changed"
    assert javascript.spliced(src, [(*lit[0], "z"), (*lit[0], "y")])[2] == "edits_overlap"
    assert javascript.spliced("a = b / 'x' / 2", [(2, 5, " b", "z")])[2] is not None


def test_splice(spark):
    f = spark.createDataFrame([(1, "a('x'); b(\"y\")"), (2, "c('z')")], "file_id long, source_text string")
    e = spark.createDataFrame([(1, 2, 5, "x", "it's"), (1, 10, 13, "y", "YY"), (2, 2, 5, "old", "n")], "file_id long, start_index int, end_index int, raw_text string, new_text string")
    rows = {r.file_id: r for r in javascript.splice(f, e).collect()}
    assert rows[1].content == "a('it\\'s'); b(\"YY\")" and rows[1].changed == 2
    assert rows[2].failure == "source_changed" and rows[2].content == "c('z')"


def test_json_paths_and_leaves(spark):
    assert J.parse_path("$['a\\'b'][0][*]") == ["a'b", 0, None]
    with pytest.raises(ValueError):
        J.parse_path("$.a")
    doc = json.dumps({"a": [1, {"b": "x"}], "s": json.dumps({"t": None}), "e": []})
    assert list(J.walk(json.loads(doc), into_strings=True)) == [("$['a'][0]", "1", "number"), ("$['a'][1]['b']", "x", "string"), ("$['s']['t']", None, "null")]
    df = spark.createDataFrame([("1", doc), ("2", "no json"), ("3", None)], "k string, d string")
    assert J.leaves(df, "k", "d").count() == 3
    edits = spark.createDataFrame([("1", "$['s']['t']", "new"), ("1", "$['a'][1]['b']", "y")], "key string, path string, new string")
    (r,) = J.apply_edits(df, edits, "k", "d").collect()
    out = json.loads(r.content)
    assert out["a"][1]["b"] == "y" and json.loads(out["s"]) == {"t": "new"}


def test_path_columns(spark):
    r = spark.range(1).select(J.slash_path(F.lit("$['a'][0]['b']")).alias("s"), J.generalise(F.lit("$['a'][0][12]")).alias("g"), X.is_ancestor(F.lit("$['a']"), F.lit("$['a'][0]")).alias("u")).head()
    assert (r.s, r.g, r.u) == ("a/0/b", "$['a'][*][*]", True)
    import re

    assert re.match(J.template_regex("$['a'][*]"), "$['a'][3]") and not re.match(J.template_regex("$['a'][*]"), "$['a']['b']")


def test_text_predicates(spark):
    rows = [("「こんにちは」",), ("\\C[1]\\!",), ("img/a.png",), ("Hello there",), ("this.x = 1",), ("「",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select("t", X.needs_translation(F.col("t")).alias("ja"), X.needs_translation(F.col("t"), "en").alias("en"), X.unwrap(F.col("t"), X.PAIRS).alias("u"), X.width(F.col("t")).alias("w"))
    got = {r.t: (r.ja, r.en, r.u, r.w) for r in df.collect()}
    assert got["「こんにちは」"][:3] == (True, False, "こんにちは")
    assert got["\\C[1]\\!"][0] is False and got["\\C[1]\\!"][3] == 0
    assert [got[k][1] for k in ("img/a.png", "Hello there", "this.x = 1")] == [False, True, False]
    assert got["「"][2] == "「" and got[None] == (None, None, None, None)


def test_residual_and_structure(spark):
    df = spark.createDataFrame([(["中文"],), (["中文です"],), (["这是ね"],), (["啊", "かな"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(X.japanese_residual(F.col("a"))).collect()] == [None, ["です"], None, ["かな"], None]
    s = spark.createDataFrame([(["a"], ["译文：x"], "long_text"), (["a"], ["x", ""], "long_text"), (["a"], ["x", "y"], "short_text")], "o array<string>, t array<string>, k string")
    assert [r[0] for r in s.select(X.structure_errors(F.col("o"), F.col("t"), F.col("k"), F.lit("Map001.json/1"))).collect()] == [["explaining_prefix"], ["unexpected_empty_line"], ["line_count"]]


def test_layout():
    assert layout.split_line("abc", 5) == ["abc"]
    parts = layout.split_line("我们走吧，明天早上再说。好吗", 8)
    assert all(layout.width(p) <= 8 for p in parts) and "".join(parts) == "我们走吧，明天早上再说。好吗"
    assert layout.repair_wraps("「a」", "“b”") == "「b」"
    assert layout.mask_terms("HP and hp", ["hp"], True).split() == ["and"]
    assert layout.render("{a}-{b}", a="1", b="2") == "1-2"
    with pytest.raises(ValueError):
        layout.render("{a}", b="1")


def test_edit_commands():
    rows = [{"code": 101}, {"code": 401, "indent": 1, "parameters": ["a"]}, {"code": 401, "indent": 1, "parameters": ["b"]}, {"code": 0}]
    more = layout.edit_commands(rows, ["x", "y", "z"], [1, 2], 401)
    assert [r.get("parameters", [None])[0] for r in more] == [None, "x", "y", "z", None] and more[3]["indent"] == 1
    assert [r.get("parameters", [None])[0] for r in layout.edit_commands(rows, ["x"], [1, 2], 401)] == [None, "x", None]
    with pytest.raises(ValueError):
        layout.edit_commands(rows, ["x"], [0], 401)


def test_copied_runs():
    assert sequence.copied_runs("The quick brown fox jumps over", "译 quick brown fox jumps 了") == ["quick brown fox jumps"]
    assert sequence.copied_runs("a b c d", "a b c d") == []
    assert sequence.copied_runs("one two", "one two") == []
    assert sequence.token_runs("one two 三 four") == ["one two", "four"]


def test_stitching(spark):
    rows = [(1, 0, "A", "a1"), (1, 1, "", "a2"), (1, 3, "", "a3"), (1, 4, "B", "b1"), (2, 0, "", "none")]
    df = spark.createDataFrame(rows, "g int, pos long, who string, t string").withColumn("opens", F.col("who") != "")
    got = {(r.g, r.block): r.lines for r in sequence.stitch(df, ["g"], "pos", "opens", "t").collect()}
    assert got == {(1, 0): "a1\na2\na3", (1, 4): "b1"}
    isl = {(r.g, r.first, r.last) for r in sequence.islands(df, ["g"], "pos", "true").collect()}
    assert isl == {(1, 0, 1), (1, 3, 4), (2, 0, 0)}
    assert {(r.g, r.pos) for r in sequence.following(df, ["g"], "pos", F.col("who") != "").collect()} == {(1, 1)}


def test_numbered_spreads_hot_groups(spark):
    rows = [("hot", f"{i:05d}") for i in range(3000)] + [("cold", f"x{i}") for i in range(7)] + [(None, "z")]
    df = spark.createDataFrame(rows, "g string, k string")
    got = {(r.g, r.k): r.seq for r in sequence.numbered(df.where("g is not null"), ["g"], "k", "seq", parts=8).collect()}
    assert all(got["hot", f"{i:05d}"] == i + 1 for i in range(3000)) and sorted(v for (g, _), v in got.items() if g == "cold") == list(range(1, 8))
    assert sequence.numbered(df.limit(0), ["g"], "k", "seq").count() == 0


def test_set_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("g", x) for x in "abc"], "g string, m string")
    b = spark.createDataFrame([("g", x) for x in "cab"], "g string, m string")
    c = spark.createDataFrame([("g", x) for x in "abd"], "g string, m string")
    f = [scope.set_fingerprint(x, ["g"], "m").head() for x in (a, b, c)]
    assert f[0] == f[1] != f[2]


def test_session_helpers(spark):
    from tessera.session import spread, stored

    df = spark.range(100, numPartitions=1)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    agg = df.groupBy("id").count()
    assert spread(agg) is agg
    assert stored(spark, df, "x").count() == 100


def test_batches(spark):
    fold = lambda rows, extend: {r.i: (r.batch, r.sequence) for r in sequence.batches(spark.createDataFrame(rows, "g int, i int, size int, who string"), ["g"], "i", "size", "who", 80, 1.0, extend).collect()}
    # a full batch takes nobody's rows and those of its last speaker, as many as it may
    rows = [(1, 0, 40, "A"), (1, 1, 40, "A"), (1, 2, 1, None), (1, 3, 1, "旁白"), (1, 4, 1, "A"), (1, 5, 1, "A"), (1, 6, 90, "B"), (1, 7, 1, "C"), (1, 8, 90, None), (1, 9, 1, None), (2, 0, 1, "A")]
    got = fold(rows[:-1], 3)
    assert got == {0: (0, 1), 1: (0, 2), 2: (0, 3), 3: (0, 4), 4: (0, 5), 5: (1, 1), 6: (1, 2), 7: (2, 1), 8: (2, 2), 9: (3, 1)}
    # a blank role is a speaker of its own, and a narrated row that fills a batch closes it
    assert fold([(1, 0, 90, ""), (1, 1, 1, ""), (1, 2, 1, "A"), (1, 3, 90, "旁白"), (1, 4, 1, "旁白")], 5) == {0: (0, 1), 1: (0, 2), 2: (1, 1), 3: (1, 2), 4: (2, 1)}
    with pytest.raises(ValueError):
        fold(rows, 0)


def test_batches_are_dispatched_whole(spark):
    # rows of a batch lie in several Arrow batches and partitions; each batch is one call
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select((F.col("id") % 4).alias("batch_id"), F.col("id").cast("string").alias("fact_id"), F.array(F.lit("x")).alias("lines")).repartition(5)
        got = runs.dispatch(df, lambda rows: [{"id": r["id"], "translation_lines": [str(len(rows))]} for r in rows]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 100 and {x for r in got for x in r.translation_lines} == {"25"}


def test_two_phase_import(spark):
    kind = "domain string, rule_index long, payload string"
    ok, bad = '{"code":101,"paths":["a"]}', "{}"
    stored = spark.createDataFrame([("event_commands", 1, ok), ("note_tags", 2, '{"file_name":"a","tags":["b"]}')], kind)
    new = spark.createDataFrame([("event_commands", 5, ok), ("event_commands", 6, ok)], kind)
    plan = validate.prepare(stored, new)
    assert [(r.violations, r.token is None) for r in plan.collect()] == [(0, False)]
    after = validate.commit(stored, new, plan)
    assert sorted(r.rule_index for r in after.collect()) == [2, 5, 6]
    assert sorted(r.rule_index for r in validate.commit(after, stored.where("domain = 'event_commands'"), plan).collect()) == [2, 5, 6]
    broken = new.withColumn("payload", F.lit(bad))
    assert sorted(r.rule_index for r in validate.commit(stored, broken, validate.prepare(stored, broken)).collect()) == [1, 2]


def test_name_boxes():
    rules = [namebox.Rule("b", "【(?P<w>[^】]+)】(?P<s>.*)", "w", "s", "translate", "【{speaker}】{body}"), namebox.Rule("c", "(?P<w>[^「】]+)「(?P<s>.*)」", "w", "s"), namebox.Rule("n", r"(?P<w>\\N\[\d+\])(?P<s>)", "w", "s", "actor_name")]
    name, speaker, source, body, rendered, pieces, error = namebox.take_apart(" 【Ana：】hi ", rules, {})
    assert (name, speaker, source, body, rendered, error) == ("b", "Ana", "Ana", "hi", "【Ana：】hi", None) and "".join(t for _, t in pieces) == "【Ana：】hi"
    assert namebox.take_apart("no box", rules, {}) is None and namebox.take_apart("x Ana「hi」 y", rules, {}) is None
    assert namebox.take_apart("\\N[3]", rules, {3: "Bo"})[1] == "Bo" and namebox.take_apart("\\N[4]", rules, {3: "Bo"})[-1] == "actor_unknown"
    assert namebox.take_apart("【 】x", rules, {})[-1] == "speaker_empty" and namebox.take_apart("【：】x", rules, {})[-1] == "speaker_empty"
    assert namebox.take_apart("【A】", rules + [namebox.Rule("d", "【(?P<w>A)】", "w")], {})[-1] == "rules_conflict"


def test_structural_masking_keeps_the_check_group(spark):
    df = spark.createDataFrame([("<b>かな</b> かな",), ("<b> </b>",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(X.mask_structures(F.col("t"), "(<b>)(?P<g>.*?)(</b>)", "g", ["<b>", "</b>"])).collect()]
    assert got == ["   かな     かな", "<b> </b>", "x", None]


def test_terminology_is_written_into_every_kind_of_field(spark):
    docs = {
        "Actors.json": [None, {"name": " Ann ", "nickname": "Ace", "note": "Ann"}], "System.json": {"elements": ["", "Fire"], "gameTitle": "Fire"},
        "Map001.json": {"displayName": "Town", "events": [None, {"list": [{"code": 101, "parameters": ["", 0, 0, 2, "Ann"]}, {"code": 401, "parameters": ["Ann", 0, 0, 2, "Ann"]}]}]},
    }
    rows = spark.createDataFrame([("p", n, json.dumps(d)) for n, d in docs.items()], "project string, file_name string, text string")
    leaves = files.leaves(rows).select(F.lit("p").alias("project"), "key", F.col("key").alias("file_name"), "path", "value")
    terms = [("actor_names", "Ann", "安"), ("actor_names", "Ann", "安娜"), ("actor_nicknames", "Ace", "王牌"), ("system_elements", "Fire", "火"), ("map_display_names", "Town", "镇"), ("speaker_names", "Ann", "安"), ("item_names", "Fire", "x")]
    edits = terminology.edits(leaves, spark.createDataFrame([("p", *t) for t in terms], "project string, category string, source string, translated string"), ["project"])
    done = {r.key: json.loads(r.content) for r in J.apply_edits(rows, edits.select("key", "path", "new"), "file_name", "text").collect()}
    assert done["Actors.json"][1] == {"name": "安", "nickname": "王牌", "note": "Ann"} and done["System.json"] == {"elements": ["", "火"], "gameTitle": "Fire"}
    told = done["Map001.json"]["events"][1]["list"]
    assert done["Map001.json"]["displayName"] == "镇" and told[0]["parameters"][4] == "安" and told[1]["parameters"][4] == "Ann"


def test_glossary_and_answers(spark):
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)], "b int, p int")
    given = spark.createDataFrame([(1, 1, "a"), (1, 9, "x"), (2, 1, "a"), (2, 1, "b"), (2, 2, "c"), (3, 9, "d"), (3, 9, "e")], "b int, p int, a string")
    got = {(r.b, r.p): (r.a, r.error) for r in scope.answers_by_prompt(asked, given, "b", "p").collect()}
    assert got == {(1, 1): ("a", None), (1, 2): (None, "missing"), (2, 1): (None, "duplicate_prompt"), (2, 2): (None, "duplicate_prompt"), (3, 1): (None, "missing")}


def test_latest_and_upsert(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 3, None)], "k string, v int, at int")
    assert {(r.k, r.v) for r in scope.latest(df, ["k"], "at").collect()} == {("a", 1), ("b", 3)}
    new = spark.createDataFrame([("a", 9, 9)], df.schema)
    assert sorted((r.k, r.v) for r in scope.upsert(df, new, ["k"]).collect()) == [("a", 9), ("b", 3)]


def test_pending_plus_translated_is_writable(spark, sf):
    from tessera.plans import relations as R

    f, i, t = R.facts(spark, sf), R.index(spark, sf), R.translations(spark, sf)
    w = scope.writable_facts(f, i)
    assert scope.pending(f, i, t).count() + w.join(t, scope.IDENTITY, "left_semi").count() == w.count()


def test_contained_terms(spark):
    texts = spark.createDataFrame([(1, "the old map of the hill"), (2, "map"), (3, None), (4, "")], "k int, t string")
    t = spark.createDataFrame([("map",), ("old map",), ("ma",), ("",), (None,)], "term string")
    assert {(r.k, r.term) for r in terms.contained(texts, "k", "t", t, "term").collect()} == {(1, "map"), (1, "old map"), (1, "ma"), (2, "map"), (2, "ma")}
    assert terms.contained(texts, "k", "t", t.limit(0), "term").count() == 0


def test_rule_violations(spark):
    rules = [
        (0, "placeholders", '{"pattern": "a*", "name": "X"}'), (1, "placeholders", '{"pattern": "(", "name": "x"}'), (2, "placeholders", '{"pattern": "a+", "name": "OK_1"}'),
        (3, "plugin_config", '{"plugin_name": " ", "paths": ["", "a"]}'), (4, "event_commands", '{"code": "1", "paths": []}'), (5, "mv_virtual_namebox", '{"pattern": "(?P<s>.)", "speaker_group": "s", "template": "{speaker}"}'),
        (6, "unknown", "{}"), (7, "note_tags", None), (8, "config_patterns", '{"required": "a+"}'),
    ]
    df = spark.createDataFrame(rules, "rule_index long, domain string, payload string")
    got = {}
    for r in validate.violations(df).collect():
        got.setdefault(r.rule_index, set()).add(r.code)
    assert got[0] == {"placeholder_pattern_matches_empty"} and got[1] == {"placeholder_pattern_invalid", "placeholder_template_invalid"} and 2 not in got and 8 not in got
    assert got[3] == {"plugin_config_plugin_name_empty", "plugin_config_path_empty"} and got[4] == {"event_command_code_invalid", "event_command_paths_invalid"}
    assert got[5] == {"mv_virtual_namebox_body_capture_missing", "mv_virtual_namebox_render_template_invalid"} and got[6] == {"rule_domain_unknown"} and got[7] == {"note_tags_rule_invalid"}
    assert {r.domain for r in validate.accepted(df).collect()} == {"config_patterns"}


def test_run_loop(spark):
    pending = spark.createDataFrame([(b, f"f{b}-{i}", ["x"]) for b in range(8) for i in range(2)], "batch_id long, fact_id string, lines array<string>")
    saved = []

    def broken(rows):
        raise ValueError("no")

    ok = runs.run(spark, pending, lambda rows: [{"id": r["id"], "translation_lines": ["y"]} for r in rows], lambda df: saved.append(df.count()))
    assert ok == {"sent": 16, "succeeded": 16, "failed": 0, "stop_reason": "finished"} and sum(saved) == 16
    bad = runs.run(spark, pending, broken, lambda df: None)
    assert bad["stop_reason"] == "error_rate" and bad["sent"] < 16
    twice = runs.dispatch(pending.where("batch_id = 0").coalesce(1), lambda rows: [{"id": r["id"], "translation_lines": []} for r in rows] * 2).collect()
    assert {r.error for r in twice} == {"duplicate_id"}
    some = runs.dispatch(pending.where("batch_id = 0").coalesce(1), lambda rows: [{"id": rows[0]["id"], "translation_lines": ["y"]}, {"id": "other", "translation_lines": []}]).collect()
    assert sorted(str(r.error) for r in some) == ["None", "missing_id"]


def test_retry_and_pace():
    calls, naps = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise runs.Recoverable("later")
        return ["ok"]

    assert runs.with_retry(flaky, 3, 2.0, naps.append) == ["ok"] and naps == [2.0, 4.0]
    with pytest.raises(ValueError):
        runs.with_retry(lambda: (_ for _ in ()).throw(ValueError()), 3, 0, naps.append)
    now, slept = [0.0], []
    p = runs.Pace(60, 1, lambda: now[0], slept.append)
    p.wait()
    p.wait()
    assert slept == [1.0]


def test_project_files(spark, tmp_path):
    base = tmp_path / "my games"
    root = base / "G 1" / "www"
    for folder in ("data", "js/plugins"):
        (root / folder).mkdir(parents=True)
    (root / "data/Map001.json").write_text('{"note": "<a:1>", "events": [null, {"note": ""}, {"x": {"note": "<b>"}}]}')
    (root / "data/Items.json").write_text('[null, {"id": 1, "name": "x", "description": " ", "iconName": "y"}]')
    (root / "data/Animations.json").write_text("[]")
    (root / "data/Extra.json").write_text("{}")
    (root / "js/plugins.js").write_text('var $plugins =\n[{"name":"A","status":true,"description":"","parameters":{"k":"v"}},{"name":"B","status":false,"description":"","parameters":{}}];\n')
    (root / "js/plugins/A.js").write_text("a('x');")
    (root / "js/plugins/B.js").write_text("b('y');")
    # a project without www whose untranslated data are kept, and a www with data alone, which is no content root
    files.write_files(spark.createDataFrame([("G2/data/Items.json", "[1]"), ("G2/data_origin/Items.json", "[2]"), ("G2/data_origin/Skills.json", "[3]"), ("G2/www/data/Armors.json", "[4]")], "path string, text string"), f"file://{base}").count()
    every = files.project_files(spark, str(base)).cache()
    std = files.standard_files(every)
    assert {(r.project, r.file_name, r.text) for r in std.where("project = 'G2'").collect()} == {("G2", "Items.json", "[2]"), ("G2", "Skills.json", "[3]")}
    assert {r.file_name for r in std.where("project = 'G 1'").collect()} == {"Map001.json", "Items.json", "Animations.json"}
    assert [(r.path, r.value) for r in files.note_sources(std, "Map*.json").orderBy("path").collect()] == [("$['events'][2]['x']['note']", "<b>"), ("$['note']", "<a:1>")]
    assert [(r.key, r.path, r.value) for r in files.visible_texts(std, F.col("project")).collect()] == [("G 1", "$[1]['name']", "x")]
    assert [(r.name, r.enabled) for r in files.plugins(every).orderBy("pos").collect()] == [("A", True), ("B", False)]
    assert [r.file_name for r in files.plugin_sources(every).collect()] == ["A.js"]
    assert files.snapshot(spark, f"{root}/js/plugins/*.js").count() == 2
    rules = spark.createDataFrame([("G 1", "Extra.json", False, ["x"]), ("G 1", "Items.json", True, ["x"]), ("G 1", "Map001.json", False, [])], "project string, file_name string, skipped boolean, paths array<string>")
    assert [r.file_name for r in files.nonstandard_files(every, rules).collect()] == ["Extra.json"]


def test_versioned_tables_and_runs(spark, tmp_path):
    root = f"file://{tmp_path}/scope"
    for v in ("v1", "v2"):
        files.replace_tables(spark, root, v, {"facts": spark.createDataFrame([(v,)], "x string")})
    assert files.current_table(spark, root, "facts").head().x == "v2"
    path = f"file://{tmp_path}/runs"
    files.append_run(spark.createDataFrame([(1, "a"), (2, "b")], "run_id int, x string"), path)
    files.replace_runs(spark, spark.createDataFrame([(1, "c")], "run_id int, x string"), path)
    assert sorted((r.run_id, r.x) for r in spark.read.parquet(path).collect()) == [(1, "c"), (2, "b")]


def test_replace_files_rolls_back(tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text("old")
    files.replace_files({str(a): "new", str(b): "made"}, str(tmp_path / "kept"))
    assert a.read_text() == "new" and b.read_text() == "made" and (tmp_path / "kept/0-a.json").read_text() == "old"
    with pytest.raises(OSError):
        files.replace_files({str(a): "newer", str(tmp_path / "none/c.json"): "x"}, str(tmp_path / "kept"))
    assert a.read_text() == "new"


def test_limits(spark):
    df = spark.range(5)
    assert scope.limited(df, [F.col("id")], 2).count() == 2 and scope.limited(df, [F.col("id")], None).count() == 5
    with pytest.raises(ValueError):
        scope.limited(df, [F.col("id")], 0)


def test_shells(spark):
    df = spark.createDataFrame([('say "hi"\n',), ("plain",), ("",)], "t string")
    r = df.select("t", X.decode_shells(X.encode_shell(X.encode_shell(F.trim("t")))).alias("d"), X.encode_shell(F.col("t")).alias("e")).collect()
    assert [x.d for x in r] == ['say "hi"\n', "plain", ""]
    assert json.loads(r[0].e) == 'say "hi"\n'


def test_packages_are_separate():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "tessera"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tessera.llm" not in p.read_text(), p


def test_commands_of_every_list_and_spelling(spark):
    paths = ["CommonEvents.json/5/0", "www/data/Map1.json/1/0/3", "Map1.json//1/0/4", "map1.json/1/0/4", "Troops.json/2/0/x", "CommonEvents.json/5/0/0", "Map1.json/1/0", "Items.json/1/0/0"]
    rows = spark.createDataFrame([(f"f{i}", p) for i, p in enumerate(paths)], "fact_id string, location_path string")
    got = {r.fact_id: (r.list_key, r.pos) for r in textual._commands(rows).collect()}
    assert got == {"f0": ("CommonEvents.json/5", 0), "f1": ("Map1.json/1/0", 3), "f2": ("Map1.json/1/0", 4), "f3": ("Map1.json/1/0", 4)}
    said = spark.createDataFrame([(1, 0, "a", "A", "x"), (1, 1, "c", "", "z"), (1, 1, "b", "", "y"), (1, 2, "d", "", "w"), (1, 4, "e", "", "v")], "g int, pos long, id string, who string, text string")
    opened = said.withColumn("opens", F.col("who") != "")
    assert [tuple(r) for r in sequence.stitch(opened, ["g"], "pos", "opens", "text", tie="id").collect()] == [(1, 0, 5, "x\ny\nz\nw\nv")]
    assert sorted((r.first, r.last, r.n) for r in sequence.islands(said, ["g"], "pos", F.lit(True)).select(F.col("first"), F.col("last"), "n").collect()) == [(0, 2, 4), (4, 4, 1)]
    assert sorted(r.id for r in sequence.following(said, ["g"], "pos", F.col("who") != "", tie="id").collect()) == ["b", "c", "d"]


def test_speakers_of_any_length_are_searched(spark, sf):
    i = R.items(spark, sf).select("fact_id", "raw_text", "speaker", "item_type").collect()
    names = {r.speaker for r in i if r.item_type == "long_text" and r.speaker}
    want = {(r.fact_id, n) for r in i for n in names if n in r.raw_text}
    assert any(len(n) < 3 for _, n in want)
    assert {tuple(r) for r in projects.j15_speakers_in_texts(spark, sf).collect()} == want
