import json
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import context as X
from weftline.operators import corpus as K
from weftline.operators import curation as U
from weftline.operators import index as I
from weftline.operators import metrics as M
from weftline.operators import records as R
from weftline.operators import splits as S
from weftline.sources.sinks import scratch as writer


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_equals_a_plain_loop(spark):
    docs = {1: "the cat sat", 2: "the dog sat on the cat", 3: "", 4: None, 5: "cat cat cat"}
    queries = {1: "cat the the", 2: "unknown"}
    d, q = frame(spark, list(docs.items()), "id int, t string"), frame(spark, list(queries.items()), "q int, t string")
    got = {(r["q"], r["id"]): r["score"] for r in I.bm25(q, d, "q", "id", "t", "t").collect()}
    toks = {k: (v or "").split() for k, v in docs.items()}
    avg, n = sum(map(len, toks.values())) / 5, 5
    idf = lambda w: math.log(1 + (n - sum(w in t for t in toks.values()) + 0.5) / (sum(w in t for t in toks.values()) + 0.5))
    want = {}
    for k, t in toks.items():
        s = sum(idf(w) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in queries[1].split() if w in t)
        if s > 0:
            want[1, k] = round(s, 6)
    assert got == pytest.approx(want)


def test_stored_index_equals_direct_search(spark, tmp_path):
    rng = random.Random(7)
    d = frame(spark, [(i, " ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 20)))) for i in range(50)], "id int, t string")
    q = frame(spark, [(1, "a b bb"), (2, "cc d d"), (3, "zzz")], "q int, t string")
    title = F.substring("t", 1, 3)
    at = f"file://{tmp_path}/index"
    I.build_index(d, "id", "t", at, title=title)
    a = I.search_index(spark, at, q, "q", "t", k=5).collect()
    b = I.bm25(q, d, "q", "id", "t", "t", title, 5).withColumnRenamed("id", "doc").collect()
    assert sorted(map(tuple, a)) == sorted((r["q"], r["doc"], r["score"], r["rank"]) for r in b)


def test_ties_and_fusion(spark):
    d = frame(spark, [(1, "x"), (2, "x"), (3, "x")], "id int, t string")
    got = I.bm25(frame(spark, [(1, "x")], "q int, t string"), d, "q", "id", "t", "t").orderBy("rank").collect()
    assert [r["id"] for r in got] == [3, 2, 1]
    lists = [frame(spark, [(1, 5, 1), (1, 6, 2)], "q int, id int, rank int"), frame(spark, [(1, 6, 1), (1, 5, 2)], "q int, id int, rank int")]
    assert [r["id"] for r in I.fuse(lists, "q", "id").orderBy("rank").collect()] == [5, 6]


@pytest.mark.parametrize("exact, docs, guides, want", [([7], 6, 4, [7, 0, 1, 2, 100, 101]), ([], 0, 5, [100, 101, 102, 103]), ([7, 8, 9, 10, 11], 3, 3, [7, 8, 9, 10, 100, 101]), ([], 2, 3, [0, 1, 100, 101])])
def test_compose(spark, exact, docs, guides, want):
    e = frame(spark, [(1, x, i) for i, x in enumerate(exact)], "q int, id int, ord int")
    r = [(1, i) for i in range(docs)] + [(1, 100 + i) for i in range(guides)]
    ranking = frame(spark, [(q, i, n + 1) for n, (q, i) in enumerate(r)], "q int, id int, rank int")
    got = I.compose(e, ranking, "q", "id", F.col("id") >= 100).orderBy("slot").collect()
    assert [x["id"] for x in got] == want


def test_rerank_and_cache(spark):
    c = frame(spark, [(1, i, i) for i in range(1, 8)], "q int, id int, rank int")
    same = c.select("q", "id", F.lit(1.0).alias("model_score"))
    assert [r["id"] for r in I.rerank(c, same, "q", "id", depth=5, k=3).orderBy("rank").collect()] == [1, 2, 3]
    pairs = frame(spark, [("a", "x", "p"), ("b", "y", "p"), ("b", "y", "p")], "pair_key string, q string, p string")
    cache = frame(spark, [("a", 9.0)], "pair_key string, model_score double")
    every, new = I.cached_scores(pairs, cache, I.pair_scorer(lambda q, p: [float(len(x)) for x in q], "q", "p"))
    assert {(r["pair_key"], r["model_score"]) for r in every.collect()} == {("a", 9.0), ("b", 1.0)} and new.count() == 1


def test_hooks(spark):
    df = frame(spark, [("a",), ("bb",), (None,)], "t string")
    assert sorted(r["embedding"][0] for r in I.embed(df, "t", lambda xs: [[len(x)] for x in xs], "p: ").collect()) == [3.0, 4.0, 5.0]

    def picky(xs):
        if len(xs) > 1 or xs[0] == "bb":
            raise MemoryError
        return ["ok"]

    assert sorted(r["response"] for r in I.generate(df.na.fill(""), "t", picky).collect()) == ["", "ok", "ok"]


def test_packing(spark):
    words = lambda n: " ".join(["w"] * n)

    def pack(rows, budget):
        made = [(i, str(i), "t", words(n), n + 11, must) for i, (n, must) in enumerate(rows)]
        df = spark.createDataFrame([(made,)], "rows array<struct<slot: int, key: string, title: string, text: string, words: int, must: boolean>>")
        return [(r["key"], r["words"]) for r in df.select(X.pack("rows", budget).alias("p")).first()["p"]]

    assert [k for k, _ in pack([(1500, False), (1500, False), (200, False)], 2000)] == ["0", "2"]
    assert pack([(5000, False)], 2000)[0][1] <= 2100
    assert [k for k, _ in pack([(1500, False), (1500, True)], 2000)] == ["0", "1"]
    assert pack([(100, False)] * 3, 1000) == [("0", 111), ("1", 111), ("2", 111)]


def test_context_rows(spark):
    gold = frame(spark, [(1, 50, 1, False), (2, 60, 1, True)], "r int, d int, ord int, miss boolean")
    got = frame(spark, [(r, d, i + 1, r == 2) for r in (1, 2) for i, d in enumerate([50, 60, 1, 2, 3, 100, 101, 102])], "r int, d int, rank int, miss boolean")
    out = X.context_rows(gold, got, "r", "d", F.col("d") >= 100, F.col("miss"), k=3).orderBy("r", "place").collect()
    assert [x["d"] for x in out if x["r"] == 1] == [50, 60, 1, 100, 101]
    assert [x["d"] for x in out if x["r"] == 2] == [50, 1, 2, 100, 101]


def test_messages(spark):
    rows = frame(spark, [(1, 1, "user", "q"), (1, 0, "system", "s"), (1, 2, "user", "again"), (2, 0, "assistant", None)], "c int, n int, role string, text string")
    m = R.messages(rows, "c", "n").withColumn("messages", F.when(F.col("c") == 1, R.with_first_content("user", F.lit("new"))).otherwise(F.col("messages")))
    got = {r["c"]: [(x["role"], x["content"]) for x in r["messages"]] for r in m.collect()}
    assert got == {1: [("system", "s"), ("user", "new"), ("user", "again")], 2: [("assistant", None)]}
    assert m.select(R.first_content("user").alias("x")).orderBy("x").collect()[0]["x"] is None


@pytest.mark.parametrize("raw, want", [('[{"question": "a", "answer": "b"}]', [(1, "a", "b")]), ('Text ```json\n[{"question": "a", "answer": "b"}, {"x": 1}, {"question": "c", "answer": "d"}]\n``` end', [(1, "a", "b"), (3, "c", "d")]), ("garbage", []), ("[not json]", []), ("", [])])
def test_teacher_answers(spark, raw, want):
    got = R.parse_answers(frame(spark, [("t", raw)], "k string, raw string"), "k", "raw").orderBy("n").collect()
    assert [(r["n"], r["question"], r["answer"]) for r in got] == want


def test_plain_answers(spark):
    long = "Answer: " + "word " * 20
    got = frame(spark, [(1, long), (2, "too short"), (3, "उत्तर： " + "शब्द " * 25)], "k int, raw string").select("k", R.plain_answer("raw").alias("x")).orderBy("k").collect()
    assert got[0]["x"].startswith("word") and got[1]["x"] is None and got[2]["x"].startswith("शब्द")


def test_round_robin(spark):
    rows = frame(spark, [("b", 1), ("a", 1), ("a", 2), ("a", 3), ("b", 2), ("c", 1)], "g string, n int")
    got = R.round_robin(rows, "g", [F.col("n")]).orderBy("turn").collect()
    assert [(r["g"], r["n"]) for r in got] == [("a", 1), ("b", 1), ("c", 1), ("a", 2), ("b", 2), ("a", 3)]


def test_greedy_keep_equals_a_plain_loop(spark):
    rng = random.Random(1)
    pairs = {(a, b) for a in range(60) for b in range(a) if rng.random() < 0.06}
    kept = []
    for i in range(60):
        if not any((i, j) in pairs for j in kept):
            kept.append(i)
    rows = spark.range(60).withColumnRenamed("id", "k")
    got = U.greedy_keep(rows, frame(spark, sorted(pairs), "a long, b long"), "k", writer(spark)).collect()
    assert sorted(r["k"] for r in got) == kept
    none = U.greedy_keep(rows, frame(spark, [], "a long, b long"), "k", writer(spark))
    assert none.count() == 60


def test_jaccard_prefixes_lose_nothing(spark):
    rng = random.Random(2)
    sets = [(i, [f"w{x}" for x in sorted({rng.randrange(25) for _ in range(rng.randrange(1, 15))})]) for i in range(60)]
    got = {(r["a"], r["b"]) for r in U.jaccard_pairs(frame(spark, sets, "k int, words array<string>"), None, "k", 0.4).collect()}
    want = {(a, b) for a, x in sets for b, y in sets if a > b and len(set(x) & set(y)) >= 0.4 * len(set(x) | set(y))}
    assert got == want


def test_bounded_history(spark):
    rows = frame(spark, [("g", i, t) for i, t in enumerate("aabca")], "g string, n int, t string")
    keep = lambda h: [r["n"] for r in U.bounded_history_dedup(rows, "n", "t", lambda a, b: a == b, h).orderBy("n").collect()]
    assert keep(200) == [0, 2, 3] and keep(1) == [0, 2, 3, 4]


def test_share_gate(spark):
    rows = spark.range(10)
    assert U.assert_share(rows, F.col("id") < 1, 0.2, "low").count() == 10
    with pytest.raises(Exception, match="too many"):
        U.assert_share(rows, F.col("id") < 5, 0.2, "low").count()


def test_splits(spark):
    rows = spark.range(200).withColumn("g", F.col("id") % 50)
    a = S.grouped_split(rows, F.col("g"), holdout=F.col("g") == 3)
    assert S.straddling(a, "g").count() == 0 and a.count() == 200
    n = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert 140 <= n["train"] <= 180 and {r["split"] for r in a.where("g = 3").collect()} == {"test"}
    b = S.grouped_split(rows.repartition(7), F.col("g"), holdout=F.col("g") == 3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert S.seeded_sample(rows, "id", 5).count() == 5


def test_byte_cap(spark):
    rows = frame(spark, [(i, s) for i, s in enumerate([5, 5, 20, 1, 1])], "k int, size int")
    assert sorted(r["k"] for r in S.byte_cap(rows, "k", "size", 12).collect()) == [0, 1]
    done = frame(spark, [(0,)], "k int")
    assert [r["k"] for r in S.byte_cap(rows, "k", "size", 30, done).orderBy("k").collect()] == [1, 2]
    assert S.byte_cap(rows.limit(0), "k", "size", 30).count() == 0


def test_statistics(spark):
    x = frame(spark, [("a", float(v)) for v in [5, 1, 4, 2, 3, 3]], "g string, x double")
    r = M.order_statistics(x, None, "x", {"p50": 0.5, "p95": 0.95, "top": 1.0}).first()
    assert (r["n"], r["p50"], r["p95"], r["top"]) == (6, 3.0, 5.0, 5.0)
    one = spark.range(1)
    m, loss = M.preference_loss(F.lit(-1.0), F.lit(-1.0), F.lit(-2.0), F.lit(-2.0))
    assert one.select(loss.alias("x")).first()["x"] == pytest.approx(math.log(2))
    m, loss = M.preference_loss(F.lit(9000.0), F.lit(0.0), F.lit(-9000.0), F.lit(0.0))
    assert one.select(loss.alias("x")).first()["x"] == pytest.approx(0.0)
    lp = one.select(M.sequence_logprob(F.array(F.lit(-1.0), F.lit(-2.0)), F.array(F.lit(False), F.lit(True))).alias("x"))
    assert lp.first()["x"] == -2.0
    runs = frame(spark, [("b", 0.5, 1, 2), ("a", 0.5, 0, 3), ("c", 0.4, 0, 1)], "n string, s double, v int, o int")
    assert M.best_run(runs, "n", "s", "v", "o").first()["n"] == "a"


def test_sections(spark):
    act = "1. Contents\n2. More\nBE IT ENACTED\nCHAPTER I\nPRELIMINARY\n1. Short title.— This is one.\n2. Scope — extends\nto all.\n3A. Long\ntitle here.—Body\nCHAPTER II\n1. 18 December.—note\n6. [Old thing.] Omitted by law\n7. Last.––end\nTHE SCHEDULE\n8. no.—no"
    df = frame(spark, [(1, act), (2, ""), (3, None)], "k int, t string").withColumn("t", K.slice_body("t"))
    got = K.split_sections(df, "k", "t").orderBy("ord").collect()
    assert [(r["section"], r["title"], r["chapter"]) for r in got] == [("1", "Short title", "CHAPTER I — Preliminary"), ("2", "Scope", "CHAPTER I — Preliminary"), ("3A", "Long title here", "CHAPTER I — Preliminary"), ("6", "Old thing", "CHAPTER II"), ("7", "Last", "CHAPTER II")]
    assert got[1]["text"] == "extends to all." and got[2]["text"].startswith("Body")


def test_mapping_cells(spark):
    cells = [(1, "1. Title", "2. Old one\n3. Old two"), (2, "", "498A."), (3, "CHAPTER V", "9. no"), (4, "(x)", "41A Notice"), (5, "3 (1) Sub", "7. x"), (6, None, None), (7, "4. New", "New Section")]
    got = K.mapping_pairs(frame(spark, [("t", *c) for c in cells], "k string, n int, left_cell string, right_cell string"), "k", "n").collect()
    assert sorted((r["new_section"], r["old_section"]) for r in got) == [("1", "2"), ("1", "3"), ("1", "41A"), ("1", "498A"), ("3", "7")]


def test_page_layout(spark):
    page = frame(spark, [(100.0, [(7.0, 10.0, "2"), (11.0, 10.0, "body"), (9.0, 80.0, "note"), (9.0, 50.0, "kept")])], "page_height double, spans array<struct<size: double, y0: double, text: string>>")
    assert [s["text"] for s in page.select(K.kept_spans().alias("s")).first()["s"]] == ["body", "kept"]
    assert page.select(K.page_lines(F.array(F.lit(" 12 "), F.lit("a"))).alias("x")).first()["x"] == "a"
    words = [(1, 100.0, 0, 0, 60.0, 10.1, 1, "right"), (1, 100.0, 0, 0, 5.0, 10.4, 0, "left"), (1, 100.0, 1, 0, 5.0, 30.0, 0, "low")]
    got = K.column_lines(frame(spark, words, "page int, width double, block int, line int, x0 double, y0 double, word_no int, word string")).orderBy("ord").collect()
    assert [(r["col"], r["text"]) for r in got] == [(0, "left"), (1, "right"), (0, "low")]
    pages = frame(spark, [(1, True, False), (2, False, True), (3, True, True), (4, False, True), (5, False, False), (6, True, True)], "p int, h boolean, n boolean")
    assert [r["p"] for r in K.table_block(pages, "p", "h", "n").orderBy("p").collect()] == [3, 4]


def test_quality(spark):
    s = frame(spark, [("a", 1, "1", "x" * 50), ("a", 2, "4", "x"), ("a", 3, "2", "x" * 50)], "k string, n int, section string, text string")
    r = K.section_quality(s, "k", "n").first()
    assert (r["monotonic"], r["gaps"], r["short"], r["clean_fraction"]) == (False, [3], ["4"], 0.0)


def test_readers_and_sinks(spark, tmp_path):
    from weftline.sources import readers, schemas, sinks

    root = f"file://{tmp_path}"
    (tmp_path / "a.jsonl").write_text('{"act_id": "alpha_2023", "section": "1", "title": "T"}\n\n{"act_id": "alpha_2023", "section": "2"}\n')
    (tmp_path / "law_mappings.jsonl").write_text('{"old_act": "OLD", "old_section": "7"}\n')
    rows, maps = readers.corpus(spark, root)
    assert rows.count() == 2 and maps.first()["old_section"] == "7"
    assert readers.generation_rows(spark, root).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [f"{root}/none"], schemas.EVAL)
    assert readers.manifest(spark, f"{root}/none").count() == 0
    new = frame(spark, [(1, "a"), (2, "b"), (2, "b")], "id int, t string")
    assert [sinks.append_new(spark, new, f"{root}/out", "id"), sinks.append_new(spark, new, f"{root}/out", "id")] == [2, 0]
    sinks.write_partitions(new, f"{root}/parts", "id")
    assert sorted(p.name for p in (tmp_path / "parts").glob("id=*")) == ["id=1", "id=2"]
    sinks.write_json(new.limit(1), f"{root}/json")
    assert json.loads(next((tmp_path / "json").glob("*.json")).read_text().splitlines()[0])["t"]
    metrics = frame(spark, [("acc", 0.5)], "name string, value double")
    assert "Accuracy: 0.5000" in sinks.metric_card(metrics, [("acc", "Accuracy")]).first()["card"]
    with pytest.raises(Exception, match="missing metric"):
        sinks.metric_card(metrics, [("none", "None")]).collect()
    (tmp_path / "x.pdf").write_bytes(b"ab")
    got = readers.parsed(readers.binaries(spark, root), lambda b: [{"n": len(b)}], "n long").collect()
    assert [r["n"] for r in got] == [2]
    vec = lambda: readers.vectors(spark, root, "m/x", new, "id", "t", lambda d: I.embed(d, "t", lambda xs: [[1.0]] * len(xs)))
    assert vec().count() == vec().count() == 3


def test_streams(spark, tmp_path):
    from weftline.streaming import flows

    root = f"file://{tmp_path}"
    a = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (2, "2024-01-01 01:10:00")], "id int, at string").select("id", F.to_timestamp("at").alias("at"))
    a.write.parquet(f"{root}/in")
    s = flows.file_stream(spark, f"{root}/in", a.schema)
    assert flows.drained(flows.first_seen(s, ["id"], "at"), "firsts").count() == 2
    for _ in range(2):
        flows.resumed_append(flows.file_stream(spark, f"{root}/in", a.schema), f"{root}/out", f"{root}/cp", "id").awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 2
    w = flows.drained(flows.windowed(s, "at", [], [F.count(F.lit(1)).alias("n")]), "wins", "complete")
    assert sorted(r["n"] for r in w.collect()) == [1, 2]
    g = flows.drained(flows.gated(s, F.when(F.col("id") == 1, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>"))), "gate")
    assert sorted(r["ok"] for r in g.collect()) == [False, False, True]


def test_generation_helpers(spark):
    from weftline.functions.citations import within_context
    from weftline.operators import generation as N

    assert [r["x"] for r in spark.createDataFrame([("forty-five",), ("seven",), ("12",), ("many",)], "w string").select(N.word_number(F.col("w")).alias("x")).collect()] == [45, 7, 12, None]
    rows = frame(spark, [("Section 4 and Section 5", ["alpha:4"])], "t string, k array<string>")
    assert rows.select(within_context("t", "k").alias("x")).first()["x"] is False
    syn = frame(spark, [(1, "a", "x", "v1"), (2, "b", "y", "v1"), (3, "a", "z", "v1"), (4, "c", "q", "v2")], "ord int, phrase string, expansion string, version string")
    assert N.pick_synonyms(syn, "v1") == [("a", "z"), ("b", "y")]
    left, right = frame(spark, [(1,), (2,)], "id int"), frame(spark, [(1, "x")], "id int, v string")
    with pytest.raises(Exception, match="no record for 2"):
        N.joined_whole(left, right, "id").collect()
    ex = frame(spark, [(1, "one two three four five six seven eight", ""), (2, "other", "the answer is this very long one here")], "id int, q string, a string")
    ev = frame(spark, [(9, "One two three four five six seven eight!", "the answer is this very long one there")], "e int, question string, expected string")
    assert {r["id"] for r in N.leaking(ex, "id", [("q", "question"), ("a", "expected")], ev, "e").collect()} == {1, 2}
    t = frame(spark, [(1, "Act", "Punishment for theft.", None, None, ["money"])], "id int, act string, title string, text string, s string, tags array<string>")
    c = F.col
    r = t.select(N.searchable(c("act"), c("title"), c("text"), c("s"), c("tags")).alias("x"), N.title_tokens(c("title"), c("tags")).alias("y"), N.section_group(c("tags")).alias("z")).first()
    assert (r["x"], r["y"], r["z"]) == ("Act Punishment for theft. money", ["punishment", "for", "theft", "money"], ["money"])
    q = N.rule_questions(frame(spark, [(1, "Act", "5", "Punishment for theft.", "within ten days or within two days"), (2, "Act", "6", "", "x")], "id int, a string, s string, t string, x string"), "id", "a", "s", "t", "x").collect()
    assert [(x["subtype"], x["answer"]) for x in q] == [("which_section", "Theft is treated in Section 5 of the Act.")]
    assert N.positions(frame(spark, [("g", 1), ("g", 2)], "g string, n int"), "g", "n").orderBy("n").collect()[1]["pos"] == 0.5


def test_whole_marker_lists(spark):
    from weftline.functions import grading as G

    assert [len(x) for x in (G.ABSTENTIONS, G.FRAMINGS, G.REPEALS, G.CLAIMS)] == [17, 8, 28, 15]
    df = spark.createDataFrame([("Kripya vakil se milein.",), ("It is illegal and I will not.",), ("The court agreed.",)], "r string")
    assert [r[0] for r in df.select(G.abstains("r")).collect()] == [True, True, False]
    own = df.select(G.judge_columns(F.array(), F.array(), "r", F.lit("qa"), abstentions=("agreed",))["abstained"].alias("x"))
    assert [r[0] for r in own.collect()] == [False, False, True]


def test_jaccard_pairs_equal_all_pairs(spark):
    import random

    from weftline.operators import curation as K

    rng = random.Random(6)
    pool = [f"w{i}" for i in range(120)]
    base = [rng.sample(pool, rng.randrange(1, 60)) for _ in range(40)]
    rows = []
    for i in range(160):
        w = set(base[0 if i % 3 == 0 else rng.randrange(40)])  # one group holds a third
        for _ in range(rng.randrange(6)):
            w.symmetric_difference_update({rng.choice(pool)})
        rows.append((i, sorted(w)))
    df = spark.createDataFrame(rows, "id long, words array<string>").where("size(words) > 0")
    sets = [(i, set(w)) for i, w in rows if w]
    for least in (0.35, 0.8):
        want = {(i, j): len(x & y) / len(x | y) for i, x in sets for j, y in sets if i > j and len(x & y) >= least * len(x | y)}
        got = {(r["a"], r["b"]): r["jaccard"] for r in K.jaccard_pairs(df, None, "id", least).collect()}
        assert got == want
        other = {(r["a"], r["b"]) for r in K.jaccard_pairs(df, df.where("id < 20"), "id", least).collect()}
        assert other == {(i, j) for i, x in sets for j, y in sets if j < 20 and len(x & y) >= least * len(x | y)}


def test_paths_are_looked_up_by_their_file_system(spark, tmp_path):
    from weftline.sources import readers

    (tmp_path / "m.jsonl").write_text('{"asset_id": "a"}\n')
    assert readers.exists(spark, f"file://{tmp_path}/m.jsonl") and not readers.exists(spark, f"{tmp_path}/none")
    assert readers.manifest(spark, f"file://{tmp_path}/m.jsonl").count() == 1 and readers.manifest(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("words, sets", [(40, 1000), (10_000, 3)])
def test_jaccard_pairs_meet_across_blocks(spark, monkeypatch, words, sets):
    from weftline.operators import setjoin

    monkeypatch.setattr(setjoin, "BLOCK_WORDS", words)
    monkeypatch.setattr(setjoin, "BLOCK_SETS", sets)
    rng = random.Random(8)
    rows = [(i, sorted({f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(1, 30))})) for i in range(90)]
    df = frame(spark, rows, "k int, words array<string>")
    for least in (0.35, 0.5, 1.0):
        pairs = U.jaccard_pairs(df, None, "k", least)
        assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()  # no pair is shuffled
        want = {(a, b) for a, x in rows for b, y in rows if a > b and len(set(x) & set(y)) >= least * len(set(x) | set(y))}
        assert {(r["a"], r["b"]) for r in pairs.collect()} == want
        two = U.jaccard_pairs(df.where("k < 50"), df.where("k >= 40"), "k", least).collect()
        assert sorted((r["a"], r["b"]) for r in two) == sorted((a, b) for a, x in rows[:50] for b, y in rows[40:] if len(set(x) & set(y)) >= least * len(set(x) | set(y)))


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    from weftline.operators import setjoin

    monkeypatch.setattr(setjoin, "HASHES", (lambda w: F.length(w).cast("long"), *setjoin.HASHES))
    df = frame(spark, [(1, ["a", "b", "cc"]), (2, ["x", "y", "zz"]), (3, ["a", "b", "zz"])], "k int, words array<string>")
    assert [(r["a"], r["b"], r["jaccard"]) for r in U.jaccard_pairs(df, None, "k", 0.2).orderBy("a", "b").collect()] == [(3, 1, 0.5), (3, 2, 0.2)]


def test_greedy_dedup_over_blocks_equals_a_plain_loop(spark, monkeypatch):
    from weftline.operators import setjoin

    monkeypatch.setattr(setjoin, "BLOCK_WORDS", 60)
    rng = random.Random(9)
    sets = [(i, sorted({f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 9))})) for i in range(60)]
    kept = []
    for _, x in sets:
        if not any(2 * len(set(x) & set(y)) >= len(set(x) | set(y)) for _, y in kept):
            kept.append((_, x))
    df = frame(spark, sets, "k int, words array<string>")
    got = U.greedy_keep(df.select("k"), U.jaccard_pairs(df, None, "k", 0.5), "k", writer(spark)).collect()
    assert sorted(r["k"] for r in got) == [k for k, _ in kept]


@pytest.mark.parametrize("cells", [2_000_000, 8])
def test_forward_search_equals_the_join(spark, monkeypatch, cells):
    from weftline.operators import forward

    monkeypatch.setattr(forward, "CELLS", cells)
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 20))) for _ in range(80)]
    rows = [*enumerate([*texts, *texts[:20], "", None])]
    d = frame(spark, rows, "id int, t string").repartition(3)
    q = frame(spark, [(1, "a b bb a"), (2, "cc d d"), (3, "zzz"), (5, "h")], "q int, t string")
    title, words = F.substring("t", 1, 3), sorted(r[0] for r in forward.asked_words(q, "q", "t").select("token").distinct().collect())
    index = forward.forward(d, "id", "t", words, title, writer(spark))
    for k, bonus in ((3, 0.0), (7, 0.75), (200, 0.75)):
        got = I.search_forward(index, words, q, "q", "t", k, title_bonus=bonus).collect()
        want = I.bm25(q, d, "q", "id", "t", "t", title, k, title_bonus=bonus).collect()
        assert sorted((r["q"], r["doc"], r["rank"]) for r in got) == sorted((r["q"], r["id"], r["rank"]) for r in want)
        assert {(r["q"], r["doc"]): r["score"] for r in got} == pytest.approx({(r["q"], r["id"]): r["score"] for r in want}, abs=1.1e-6)
    twice = forward.forward(frame(spark, [(1, "a b"), (1, "b c"), (2, "a"), (3, ""), (3, "")], "id int, t string"), "id", "t", ["a", "b", "c"], None, writer(spark))
    assert sorted((r["doc"], r["len"], r["words"], r["tf"]) for r in twice.collect()) == [(1, 4, [0, 1, 2], [1, 2, 1]), (2, 1, [0], [1]), (3, 0, [], [])]
    none = frame(spark, [], "q int, t string")
    assert I.search_forward(index, words, none, "q", "t", 3).collect() == []
    assert I.search_forward(forward.forward(d.where("false"), "id", "t", words, title, writer(spark)), words, q, "q", "t", 3).collect() == []


def test_near_pairs_across_blocks_equal_all_pairs(spark, monkeypatch):
    from difflib import SequenceMatcher

    from weftline.operators import setjoin

    monkeypatch.setattr(setjoin, "BLOCK_WORDS", 50)
    rng = random.Random(12)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(9)) for _ in range(20)) for _ in range(8)]
    texts = [" ".join(w if rng.random() > 0.05 else "x" for w in rng.choice(base).split()) for _ in range(40)]
    firsts = [i for i, t in enumerate(texts) if texts.index(t) == i]
    want = {(i, texts.index(t)) for i, t in enumerate(texts) if texts.index(t) != i}
    near = {(a, b) for a in firsts for b in firsts if a > b and SequenceMatcher(None, texts[a], texts[b]).ratio() > 0.92}
    df = frame(spark, list(enumerate(texts)), "id int, t string")
    assert near and {(r["a"], r["b"]) for r in U.near_pairs(df, None, "id", "t").collect()} == want | near
