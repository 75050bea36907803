import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import curation as C
from paperloom.operators import dedup as D
from paperloom.operators import grading as G
from paperloom.operators import metrics as M
from paperloom.operators import retrieval as R
from paperloom.operators import tokens as B
from paperloom.operators.chunks import ChunkRules, chunks, coverage, cut_section
from paperloom.operators.graph import components
from paperloom.operators.index import queries_of, tokenized
from paperloom.sources import documents as S
from paperloom.streaming.incremental import ingest


def one(spark, schema, rows, *columns):
    return [tuple(r) if len(r) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_terms_and_query_terms(spark):
    texts = [("Don't STOP at 3.5 or x_1, Straße!",), ("What is the idea of the paper?",), ("the of",), (None,)]
    assert one(spark, "t string", texts, T.tokens(F.col("t"))) == [["don't", "stop", "at", "3.5", "or", "x_1", "strasse"], ["what", "is", "the", "idea", "of", "the", "paper"], ["the", "of"], []]
    assert one(spark, "t string", texts[1:3], T.query_terms(F.col("t"))) == [["method"], ["the", "of"]]


def test_citations_lines_and_phrases(spark):
    rows = [("a [C1, C3] b [C0] [c2]", "A  [c0]")]
    assert one(spark, "t string, p string", rows, T.citation_labels(F.col("t"))) == [["C1", "C3"]]
    assert one(spark, "t string, p string", rows, T.strip_citations(F.col("t"))) == ["a b [C0] [c2]"]
    assert one(spark, "t string, p string", [("One\nTwo words", "two  WORDS"), ("words two", "two words"), ("two", "two words")], T.phrase_present(F.col("t"), F.col("p"))) == [True, True, False]
    assert one(spark, "t string, k int", [("a\nb\nc", 4)], T.line_of(F.col("t"), F.col("k"))) == [3]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "c")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a zzz"), (8, "c")], "item_id long, text string")
    got = {(r.query_id, r.doc_id): (r.rank, r.score) for r in R.bm25(tokenized(docs), queries_of(items)).collect()}
    idf = np.log(1 + 1.5 / 2.5)
    assert got[8, 3] == (1, round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 / 2)), 6)) and got[8, 2][0] == 2
    assert (9, 1) not in got  # "a" is a stop word and the other term is in no document


def test_metrics_by_hand(spark):
    found = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1)], "query_id long, rank long, relevant int")
    gold = spark.createDataFrame([(1, 4), (2, 2), (3, 0)], "query_id long, n_gold long")
    got = {r.query_id: r for r in M.per_query(found, gold, 3).collect()}
    ideal = 1 + 1 / np.log2(3) + 1 / np.log2(4)
    assert (got[1].precision, got[1].recall, got[1].reciprocal_rank) == (0.666667, 0.5, 0.5)
    assert got[1].average_precision == round((1 / 2 + 2 / 3) / 4, 6) and got[1].ndcg == round((1 / np.log2(3) + 1 / np.log2(4)) / ideal, 6)
    assert got[2].recall == 0 and got[3].recall == 1


def test_fusion_with_a_missing_side(spark):
    left = spark.createDataFrame([(1, 10, 1, 2.0), (1, 11, 2, 1.0)], "query_id long, doc_id long, rank long, score double")
    right = spark.createDataFrame([(1, 11, 1, 4.0)], "query_id long, doc_id long, rank long, score double")
    got = {r.doc_id: r.score for r in R.reciprocal_rank_fusion(left, right).collect()}
    assert got == {10: round(1 / 61, 9), 11: round(1 / 62 + 1 / 61, 9)}
    assert {r.doc_id: r.score for r in R.weighted_fusion(left, right).collect()} == {10: 0.5, 11: 0.75}


def test_jaccard_is_brute_force(spark):
    rng = np.random.default_rng(0)
    base = [set(rng.choice(60, 25).tolist()) for _ in range(12)]
    texts = [" ".join(f"w{x}" for x in b - {min(b)} | ({99 + k} if k else set())) for b in base for k in range(4)] + ["", "!!", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(re.findall("[a-z0-9]+", t or "")) for t in texts]
    distinct = set(sets)
    links = {s: {t for t in distinct if t != s and len(s | t) and len(s & t) / len(s | t) >= 0.8} for s in distinct}
    got = {r.doc_id: r for r in D.near_duplicates(docs, 0.8).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert got[i].n_links == len(links[s]) and got[i].class_id == sets.index(s)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (6, 5), (4, 7)]
    nodes = spark.createDataFrame([(i,) for i in range(10)], "node long")
    got = dict(map(tuple, components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 7: 1, 5: 5, 6: 5, 8: 8, 9: 8}


def test_quota_split_rounds_half_to_even(spark):
    for n, (test, validation) in {1: (0, 0), 2: (1, 0), 3: (1, 1), 10: (2, 2), 30: (4, 4)}.items():
        got = [r.split for r in C.quota_split(spark.createDataFrame([(f"p{i}",) for i in range(n)], "p string"), "p").collect()]
        assert (got.count("test"), got.count("validation"), len(got)) == (test, validation, n)


def test_trust_tiers(spark):
    rows = [("codex_approved", False, False), ("codex_approved", True, False), ("codex_approved", True, True), ("codex_curated", False, False), ("human_approved", False, False), ("x", True, False)]
    tier = lambda t: one(spark, "s string, a boolean, c boolean", rows, C.eligible(F.col("s"), F.col("a"), F.col("c"), t))
    assert tier("human-only") == [False, False, False, False, True, False]
    assert tier("human-and-audited") == [False, True, False, False, True, False]
    assert tier("all-trusted") == [True, True, False, True, True, False]
    assert tier("codex-curated-only") == [False, False, False, True, False, False]


def test_audit_sample_size(spark):
    rows = [(f"e{i}", 0.5 if i else 0.94, i == 3, False) for i in range(41)]
    got = {r.example_id: r.reasons for r in C.audit_sample(spark.createDataFrame(rows, "example_id string, confidence double, disagreement boolean, novel boolean")).collect()}
    assert len(got) == 5 and got["e0"] == "near_threshold" and got["e3"] == "reviewer_disagreement"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!", max_size=600))
def test_chunks_cover_a_section(text):
    rules = ChunkRules(target=60, maximum=90, overlap=10, minimum=8)
    spans = cut_section(text, rules)
    assert not text or (spans[0][0] == 0 and spans[-1][1] == len(text))
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert c == b - rules.overlap and a < c < d and b - a <= rules.maximum


def test_chunks_prefer_sentences(spark):
    text = "x" * 50 + ". " + "y " * 30 + "z" * 40
    assert cut_section(text, ChunkRules(60, 90, 10, 8))[0] == (0, 52)
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.covered) for r in coverage(chunks(docs), docs).collect()] == [(1, True)]


def test_merges_round_trip(spark):
    docs = spark.createDataFrame([("aaaa",), ("abab é",), (None,)], "text string")
    found = B.train_merges(docs, 5)
    assert found[0] == (0, 97, 97, 3)  # overlapping pairs count
    merges = {(a, b): rank for rank, a, b, _ in found}
    for text in ("aaaa", "abab é", "", "zaab"):
        assert B.decode_merges(B.encode_merges(text.encode(), merges), merges).decode() == text
    assert B.replace_pair([1, 1, 1], 1, 1, 9) == [9, 1]


def test_profile_prompt_wins(spark):
    p = G.profile(F.col("t"), F.col("c"))
    rows = [("Explain for a PhD, briefly", "eli5 please"), ("more", "I am a beginner"), ("Derive it in a table", None)]
    assert one(spark, "t string, c string", rows, p["background"]) == ["researcher", "high_school", "undergraduate"]
    assert one(spark, "t string, c string", rows, p["depth"]) == ["brief", "standard", "standard"]
    assert one(spark, "t string, c string", rows, p["format"]) == ["prose", "prose", "table"]


def test_markdown_and_pages(spark):
    assert [(s[1], s[2], s[3]) for s in S.split_markdown("pre\n# A\n```\n# no\n```\n### C\n## B ##\n")] == [(0, None, []), (1, "A", ["A"]), (3, "C", ["A", "C"]), (2, "B", ["A", "B"])]
    pages = spark.createDataFrame([("s", 2, "bc"), ("s", 1, "a"), ("s", 3, ""), ("s", 4, "d")], "source string, page long, text string")
    assert [(r.page, r.start_character, r.end_character) for r in S.from_pages(pages).orderBy("page").collect()] == [(1, 0, 1), (2, 2, 4), (4, 5, 6)]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nx")
    (tmp_path / "b.txt").write_bytes("é".encode())
    got = {r.source_path.rpartition("/")[2]: r for r in S.read_files(spark, str(tmp_path)).collect()}
    assert got["a.md"].media_type == "text/markdown" and (got["b.txt"].text, got["b.txt"].byte_length) == ("é", 2)
    (tmp_path / "c.txt").write_bytes(b"\xff")
    with pytest.raises(S.SourceError):
        S.read_files(spark, str(tmp_path))
    assert S.read_files(spark, str(tmp_path), errors="replace").count() == 3
    (tmp_path / "d.pdf").write_text("x")
    with pytest.raises(S.SourceError):
        S.read_files(spark, str(tmp_path), errors="replace")


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.5]), (2, None, [])], "k long, t string, v array<double>")
    path = str(tmp_path / "x")
    S.write_artifact(df, path)
    assert S.read_artifact(spark, path).count() == 2
    with pytest.raises(S.SourceError):
        S.read_artifact(spark, path, version=2)
    df.limit(1).write.mode("overwrite").parquet(f"{path}/table")
    with pytest.raises(S.SourceError):
        S.read_artifact(spark, path)


def test_ingest_takes_each_file_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([(1,)], "k long").coalesce(1).write.parquet(folder)
    for more in (2, 3):
        ingest(spark, folder, "*.parquet", "k long", lambda rows: rows, out, state)
        spark.createDataFrame([(more,)], "k long").coalesce(1).write.mode("append").parquet(folder)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]


def test_stored_index_and_dispatch(spark, tmp_path):
    from paperloom.operators import index as I
    from paperloom.operators import retrieval as R

    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red red hen"), (3, None), (4, "blue sky over the fox")], "doc_id bigint, text string")
    queries = I.queries_of(spark.createDataFrame([(9, "red fox")], "item_id bigint, text string"))
    index = I.build_index(docs, f"file://{tmp_path}/index", R.tfidf_weight)
    terms = I.tokenized(docs)
    for method, plain in (("bm25", R.bm25(terms, queries, 3)), ("tfidf", R.tfidf(terms, queries, 3))):
        assert R.search(index, queries, method, 3).collect() == plain.collect()
    assert [r.doc_id for r in R.search(index, queries, "hybrid").collect()][0] == 1
    for wrong in (lambda: R.search(index, queries, "semantic"), lambda: R.search(index, queries, "tfidf", k1=2.0)):
        with pytest.raises(ValueError, match="method|option"):
            wrong()


def test_evaluation_operators(spark):
    from paperloom.operators import evaluation as E
    from paperloom.operators import records as R

    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    array = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    found = {k: get(v) for k, v in E.concepts(F.lit("What results does Adam report in 3.5 epochs of GPT-4?")).items()}
    assert found["entities"] == ["adam", "gpt-4"] and found["numbers"] == ["3.5", "4"] and found["intent"] == "numerical" and found["optional"] == ["report"]
    assert get(E.citation_display(F.lit("P"), F.lit(2), F.lit(3), F.lit(1), F.lit(9), array("a", "b"))) == "[P, pp. 2–3, § a › b]"
    assert get(E.citation_display(F.lit("P"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(4), F.lit(4), array())) == "[P, line 4]"
    assert get(E.fact_present(F.lit("the rate  was low"), F.lit("low rate"))) and not get(E.fact_present(F.lit("the rate was low"), F.lit("low = rate")))
    empty = {k: get(v) for k, v in E.set_metrics(array(), array()).items()}
    assert empty == {"precision": 1.0, "recall": 1.0, "f1": 1.0, "exact": 1.0}
    gold = spark.createDataFrame([(1, 10, 2), (1, 11, 1)], "query_id int, doc_id int, grade int")
    hits = spark.createDataFrame([(1, 1, 11, 0.9), (1, 2, 12, 0.5), (2, 1, 5, 0.1)], "query_id int, rank int, doc_id int, score double")
    grades = {r.query_id: r for r in E.retrieval_grades(hits, gold).collect()}
    # gains 1 of an ideal of 3 + 1 / log2(3); the missing one counts as rank 3
    assert grades[1].ndcg == round(1 / (3 + 1 / 1.584962500721156), 6) and grades[1].mean_relevant_rank == 2.0 and grades[1].recall_at_1 == 0.5
    assert grades[2].ndcg == 1.0 and grades[2].mean_relevant_rank is None
    passes = [(1, "evidence_critic", 1, "supports"), (1, "evidence_critic", 2, "unsupported"), (1, "answer_critic", 1, "direct"), (1, "final_adjudicator", 1, "direct")]
    got = E.disagreements(spark.createDataFrame(passes, "id int, role string, seq int, outcome string")).first()
    assert got.categories == ["evidence_critic_vs_answer_critic", "final_adjudicator_overrides_majority"]
    with pytest.raises(ValueError, match="filter"):
        E.metadata_filter(one, colour="red")
    with pytest.raises(ValueError, match="single"):
        E.record_reviews(one.select("id", F.lit("p").alias("status")), spark.createDataFrame([(7, "a")], "id bigint, status string"))
    assert [get(R.safe_filename(F.lit(x))) for x in ("a/b c?.PDF", ".md", "x.exe", "")] == ["b c_.PDF", "paper.md", None, None]


def test_json_store(spark, tmp_path):
    from paperloom.operators.records import read_json_store

    path = f"file://{tmp_path}/store.json"
    assert read_json_store(spark, path, "a int").count() == 0
    (tmp_path / "store.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [r.a for r in read_json_store(spark, path, "a int").collect()] == [1, 2]


def test_long_path_keeps_the_plan_small(spark):
    n = 64
    found = components(spark.range(n + 1).toDF("node"), spark.range(n).selectExpr("id AS a", "id + 1 AS b"))
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
    assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(n + 1)}


@pytest.mark.parametrize("threshold", [0.7, 0.9, 1.0])
def test_near_duplicates_in_chunks_are_brute_force(spark, threshold):
    rng = np.random.default_rng(1)
    base = [rng.choice(400, n).tolist() for n in (9, 10, 11, 19, 20, 40, 60)]
    sets = [frozenset(f"w{x}" for x in b[k % 3 :]) | {f"x{k}-{j}".replace("-", "y") for j in range(k % 4)} for b in base for k in range(12)]
    docs = spark.createDataFrame([(k, " ".join(sorted(s))) for k, s in enumerate(sets)], "doc_id long, text string")
    links = {s: [t for t in set(sets) if t != s and len(s & t) >= threshold * len(s | t) - 1e-9] for s in sets}
    got = {r.doc_id: r for r in D.near_duplicates(docs, threshold, most=5).collect()}
    assert [(got[k].class_id, got[k].n_links) for k in range(len(sets))] == [(sets.index(s), len(links[s])) for s in sets]
    for k, s in enumerate(sets):
        reached, ahead = {s}, [s]
        while ahead:
            more = set(links[ahead.pop()]) - reached
            reached |= more
            ahead += more
        assert got[k].component_id == min(map(sets.index, reached))
