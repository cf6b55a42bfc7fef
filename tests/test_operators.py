import hashlib
import hmac
import re
import time
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textward.functions import aligned as A
from textward.functions import spans as S
from textward.functions import text as T
from textward.operators import check as C
from textward.operators import joins as J
from textward.operators import judge as G
from textward.operators import judgments as D
from textward.operators import policies as P
from textward.operators.planning import pieces
from textward.plans.config import judgments_from, policies_from
from textward.sources import hooks as H
from textward.streaming.prompts import with_prompt
from textward.streaming.replies import assemble


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_spans_are_code_points(spark):
    texts = ["a1b22", "", "é😀 12 x", "no", "7"]
    rows = C.findings_of(frame(spark, *texts), P.Regex(patterns=("[0-9]+",)), "untrusted").select("text", "found").collect()
    for r in rows:
        assert [(s["start"], s["end"]) for x in r["found"] for s in x["spans"]] == [m.span() for m in re.finditer("[0-9]+", r["text"])]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20), st.lists(st.tuples(st.integers(0, 20), st.integers(0, 4), st.text(max_size=3)), max_size=5), st.lists(st.tuples(st.integers(0, 20), st.integers(0, 4), st.text(max_size=3)), max_size=5))
def test_aligned_equals_a_map_by_character(text, one, two):
    view, places = A.Aligned(text), [(i, i + 1) for i in range(len(text))]
    for drawn in (one, two):
        edits, at = [], 0
        for start, size, new in sorted(drawn):
            if at <= start and start + size <= len(view.text):
                edits.append((start, start + size, new))
                at = start + size
        out, at = [], 0
        for start, end, new in edits:
            low, high = view.origin(start, end)
            out += places[at:start] + [(low, high)] * len(new)
            at = end
        places = out + places[at:]
        view = view.edited(edits)
    assert len(places) == len(view.text)
    assert [view.origin(i, i + 1) for i in range(len(view.text))] == places


@settings(max_examples=80, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=30) | st.text("aeK１ＡﾞﾊがßİﬁΣ\u0301\u0327\u200d\u00ad각ᄀ", max_size=15))
def test_views_equal_their_definition(text):
    table = {ord("l"): "1", ord("m"): "rn"}
    plain = unicodedata.normalize("NFKC", text)
    assert A.normalized(A.Aligned(text), "NFKC").text == plain
    assert A.plain_view(text).text == A.IGNORABLE.sub("", plain)
    view = A.folded_view(text, table)
    folded = unicodedata.normalize("NFD", A.IGNORABLE.sub("", plain.casefold()))
    assert view.text == unicodedata.normalize("NFD", folded.translate(table))
    spans = [view.origin(i, i + 1) for i in range(len(view.text))]
    assert all(0 <= a <= b <= len(text) for a, b in spans)


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n", min_size=1, max_size=300), st.integers(4, 60))
def test_pieces_cover(text, room):
    found = pieces(text, room)
    assert found[0][0] == 0 and found[-1][1] == len(text) and all(b - a <= room for a, b in found)
    assert all(a < c <= b for (a, b), (c, _) in zip(found, found[1:], strict=False))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=6), min_size=1, max_size=12))
def test_merged_equals_cover(spark, cases):
    rows = [(i, [(a, a + n) for a, n in c]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, s {S.SPAN}").select("i", S.merged(F.col("s")).alias("m"))
    for r in df.collect():
        want: list[list[int]] = []
        for a, b in sorted(rows[r["i"]][1]):
            if want and a <= want[-1][1]:
                want[-1][1] = max(b, want[-1][1])
            else:
                want.append([a, b])
        assert [[x["start"], x["end"]] for x in r["m"]] == want


def test_check_masks_and_maps_back(spark):
    text = "x​ mail ann@example.org now"
    out = C.check(frame(spark, text, None, ""), "untrusted", [P.InvisibleText(), P.Pii()]).orderBy("doc_id").collect()
    assert out[0]["onward"] == "x mail an****rg now"
    spans = {f["label"]: [(s["start"], s["end"]) for s in f["spans"]] for f in out[0]["findings"]}
    assert spans == {"invisible_text": [(1, 2)], "EMAIL_ADDRESS": [(text.index("ann"), text.index(" now"))]}
    assert [r["onward"] for r in out[1:]] == ["", ""] and all(r["ok"] for r in out)


def test_stages_and_refusals(spark):
    df = frame(spark, "card 4111 1111 1111 1111")
    row = C.check(df, "tool_call", [P.Pii()]).first()
    assert (row["decision"], row["onward"]) == ("block", "Tool call blocked.")
    row = C.check(df, "output", [P.Pii()]).first()
    assert row["decision"] == "allow" and row["onward"] == "card 4111 1111 1111 1111"
    row = C.check(df, "untrusted", [P.Substrings(terms=("CARD",))]).first()
    assert row["onward"] == "Blocked: substrings."
    row = C.check(df, "untrusted", max_input_bytes=3).first()
    assert (row["onward"], row["complete"]) == ("Blocked: input_too_long.", False)


def test_substrings_overlap_and_whole_words(spark):
    def spans(policy, text):
        found = C.findings_of(frame(spark, text), policy, "input").first()["found"]
        return [(s["start"], s["end"]) for x in found for s in x["spans"]]

    assert spans(P.Substrings(terms=("aa",)), "baaab") == [(1, 4)]
    assert spans(P.Substrings(terms=("cat",), whole_words=True), "cat concat cat_ Cat.") == [(0, 3), (16, 19)]


def test_keyed_hashes(spark):
    key = b"k" * 32
    row = frame(spark, "value").select(T.hmac_sha256(key, F.col("text")).alias("h"), T.token(key, F.col("text")).alias("t")).first()
    assert row["h"] == hmac.new(key, b"value", hashlib.sha256).hexdigest()
    assert re.fullmatch(J.TOKEN, row["t"])


def test_restore_only_authorized(spark):
    key = b"k" * 32
    store = J.redactions(spark.createDataFrame([(1, ["ann@a.org", "bob@b.org"])], "c long, v array<string>"), "c", "v", key)
    token = {r["value"]: r["token"] for r in store.collect()}
    said = spark.createDataFrame([(1, 1, f"hi {token['ann@a.org']} and {token['bob@b.org']}.")], "id long, c long, text string")
    allowed = store.where("value = 'ann@a.org'").select("scope_id", "token")
    assert J.restore(said, store, "id", "c", "text", allowed).first()["restored"] == f"hi ann@a.org and {token['bob@b.org']}."


def test_placeholders_are_escaped_once(spark):
    once = P.escape_placeholders(F.col("text"))
    row = frame(spark, "[TW_PII_x] [TW:PII_x]").select(once.alias("a"), P.escape_placeholders(once).alias("b")).first()
    assert row["a"] == row["b"] == "[TW:PII_x] [TW:PII_x]"


def test_fold_finds_lookalikes(spark):
    rows = [r["f"] for r in T.folded(frame(spark, "pay", "Ｐаy", None), "text", "f").orderBy("doc_id").collect()]
    assert rows[0] == rows[1] and rows[2] is None


def test_origins():
    assert T.canonical_origin("HTTPS://Example.org./x") == ("https", "example.org", 443)
    for bad in ("ftp://a.org", "http://u@a.org", "http:\\\\a.org", "http://a%2e.org", "http://a.org:99999", None):
        assert T.canonical_origin(bad) is None


def test_judgments(spark):
    df = frame(spark, "a", "b", "c")
    answers = spark.createDataFrame([(0, 0.2), (0, 0.95), (1, 0.5)], "doc_id long, p_yes double")
    out = C.check(G.judged(df, answers, "doc_id", "toxicity", G.Threshold(0.9, 0.4)), "input", judged="judgment").orderBy("doc_id").collect()
    assert [(r["decision"], r["complete"]) for r in out] == [("block", True), ("allow", True), ("block", False)]
    assert out[1]["findings"][0]["action"] == "flag"


def test_chunks_cover(spark):
    text = "word " * 200 + "é" * 300
    spans = frame(spark, text).select(G.chunks(F.col("text"), 150).alias("s")).first()["s"]
    assert spans[0]["start"] == 0 and spans[-1]["end"] == len(text)
    assert all(a["end"] >= b["start"] > a["start"] for a, b in zip(spans, spans[1:], strict=False))
    assert all(len(text[s["start"] : s["end"]].encode()) <= 150 for s in spans)


def test_hooks(spark):
    df = spark.createDataFrame([('{"hook_event_name":"Stop","last_assistant_message":"x"}',), ("nonsense",)], "value string")
    assert [(r["stage"], r["outcome"]) for r in H.events(df, "codex").collect()] == [("output", "check"), (None, "reject")]
    df = spark.createDataFrame([('{"stdout":"a","stderr":"b"}',), ('{"content":"c"}',)], "v string")
    assert [r[0] for r in df.select(H.tool_text(F.col("v"))).collect()] == ["a\nb", "c"]
    said = spark.createDataFrame([('{"ok":true,"decision":"allow","onward":"x"}',), ("broken",)], "v string").select(H.decided(F.col("v")).alias("d"))
    assert [(r["d"]["ok"], r["d"]["decision"]) for r in said.collect()] == [(True, "allow"), (False, "block")]


def test_columns_of_the_caller_stay(spark):
    df = frame(spark, "a clown").withColumns({c: F.lit("mine") for c in ("found", "score", "judgment", "__all", "edited", "sanitized", "x")})
    out = C.check(df, "input", [P.Substrings(terms=("clown",))])
    row = out.first()
    assert row["found"] == row["score"] == row["__all"] == row["edited"] == "mine" and row["decision"] == "block" and len(set(out.columns)) == len(out.columns)


def test_policies_keep_their_contract(spark):
    for bad in (([("no label!", "flag", [])], []), ([("x", "shout", [])], []), ([("x", "flag", [(0, 99)])], []), ([], [(0, 2, "a"), (1, 3, "b")]), None):
        with pytest.raises(P.PolicyFailure):
            P.checked(P.Transform(name="t"), bad, 5)


def test_judgments_are_validated():
    yes, pick, level = D.YesNo("?"), D.Choice("?", ("a", "b")), D.Score("?", ("x", "y"))
    for make in (
        lambda: D.judge("1x", yes, threshold=0.5), lambda: D.judge("x", {}, threshold=0.5), lambda: D.judge("x", yes, threshold=2), lambda: D.judge("x", yes, threshold=0.5, violating=("a",)),
        lambda: D.judge("x", pick, threshold=0.5), lambda: D.judge("x", pick, threshold=0.5, violating=("c",)), lambda: D.judge("x", level, threshold=0.5, violation_level=2),
        lambda: D.judge("x", yes, threshold=0.5, context="required"), lambda: D.judge("x", yes, threshold=0.5, max_items=2), lambda: D.Choice("?", ("a",)), lambda: D.Score("?", ("a", "a")),
        lambda: D.hazards(["S99"], threshold=0.5), lambda: D.language(["other"], threshold=0.5), lambda: D.code("maybe", ["sql"], threshold=0.5), lambda: D.Threshold(0.5, 0.6),
    ):
        with pytest.raises(P.PolicyError):
            make()


def test_dumps_are_bound_to_key_and_scope(spark):
    store = spark.createDataFrame([("s", T.token_of(b"k" * 32, "v"), "v")], "scope_id string, token string, value string")
    sealed = J.dumped(store, b"k" * 32)
    assert J.loaded(sealed, b"k" * 32, b"k" * 32).collect() == store.collect()
    for wrong in (J.loaded(sealed, b"j" * 32), J.loaded(sealed.withColumn("scope_id", F.lit("t")), b"k" * 32), J.loaded(sealed, b"k" * 32, b"x" * 32)):
        with pytest.raises(Exception):  # noqa: B017
            wrong.collect()


def test_one_conversation_a_check(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "b", None)], "id int, s string, t string")
    assert J.one_scope(df, "id", ["s", "t"]).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        J.one_scope(df.withColumn("t", F.lit("c")), "id", ["s", "t"]).collect()


def test_folding_is_linear():
    text = "é" * 20_000
    times = []
    for k in (1, 4):
        began = time.perf_counter()
        A.folded_view(text * k, {})
        times.append(max(time.perf_counter() - began, 0.02))
    assert times[1] < 8 * times[0]


def test_limits_and_json(spark):
    df = frame(spark, "one two three four", 'x {"a": 1} y', "[1", "")
    cut = C.findings_of(df, P.TokenLimit(most=2, truncate=True), "input").orderBy("doc_id").collect()
    assert cut[0]["edited"] == "one two" and cut[0]["found"][0]["action"] == "flag" and cut[3]["edited"] == ""
    found = C.findings_of(df, P.JsonCheck(required_elements=1), "output").orderBy("doc_id").collect()
    assert [len(r["found"]) for r in found] == [1, 0, 1, 1]


def test_configuration():
    found = policies_from('{"model": "m", "guards": {"pii": {"entities": ["UUID"]}, "regex": {"enabled": false}, "reading_time": {"most": 5}}}')
    assert [p.name for p in found] == ["pii", "reading_time"] and found[1].most == 5
    for bad in ("{", '{"guards": {"other": {}}}', '{"guards": {"pii": {"x": 1}}}', '{"guards": {"reading_time": {"most": true}}}', '{"guards": {"reading_time": {"most": 0}}}'):
        with pytest.raises(P.PolicyError):
            policies_from(bad)
    asked = judgments_from('{"guards": {"injection": {"threshold": 0.7}, "topics": {"threshold": {"block_at": 0.9, "flag_at": 0.5}, "deny": ["x y"]}, "pii": {}}}')
    assert [j.name for j in asked] == ["injection", "topics"] and list(asked[1].questions) == ["x_y"]
    for bad in ('{"guards": {"injection": {}}}', '{"guards": {"injection": {"threshold": "high"}}}', '{"guards": {"injection": {"threshold": 0.5, "other": 1}}}'):
        with pytest.raises(P.PolicyError):
            judgments_from(bad)


def test_streamed_replies(spark, tmp_path):
    schema = "session string, message string, seq long, delta string, final boolean"
    batches = [[("s", "m", 1, "Hel", False), ("s", "n", 1, "x", False)], [("s", "m", 2, "lo", True)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = assemble(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("replies").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").start()
    try:  # with a timeout on state the query goes on with empty batches, so it never counts as idle
        for _ in range(90):
            if spark.table("replies").count() or not run.isActive:
                break
            time.sleep(1)
    finally:
        run.stop()
    assert [tuple(r) for r in spark.table("replies").collect()] == [("s", "m", "Hello", 2)]


def test_session_prompts_in_a_stream(spark, tmp_path):
    schema = "session string, seq long, stage string, text string, ok boolean"
    batches = [[("s", 1, "output", "early", True), ("s", 2, "input", "first", True), ("s", 3, "tool_call", "{}", True)], [("s", 4, "input", "bad", False), ("s", 5, "output", "reply", True), ("../x", 1, "input", "no", True)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = with_prompt(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("prompts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check").start()
    run.awaitTermination(120)
    got = {r["seq"]: (r["prompt"], r["refused"]) for r in spark.table("prompts").collect()}
    assert got == {1: (None, True), 2: (None, False), 3: ("first", False), 4: ("first", False), 5: ("first", False)}
    rows = spark.createDataFrame([r for b in batches for r in b if r[0] == "s"], schema)
    twin = G.last_prompt(rows, "session", "seq", F.expr("stage = 'input' and ok"), F.col("text"))
    assert {r["seq"]: r["prompt"] for r in twin.collect()} == {k: p for k, (p, _) in got.items()}
