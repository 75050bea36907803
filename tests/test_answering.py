import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.operators import answering as A
from paperloom.operators import semantic as L
from paperloom.operators.index import tokenized


def cut(text):
    return [(text[a:b], kind) for a, b, kind in A.sentence_spans(text)]


def test_sentences():
    assert cut("One is 3.5 m, e.g. that. Two! [C1, C2] Three") == [("One is 3.5 m, e.g. that.", "prose"), ("Two! [C1, C2]", "prose"), ("Three", "prose")]
    assert cut("# Head\n- a b\ntext\nmore. x\n```\na. b\n```\n") == [("# Head", "heading"), ("- a b", "bullet"), ("text\nmore.", "prose"), ("x", "prose"), ("```\na. b\n```", "code")]
    assert cut("") == [] and cut(" \n ") == []


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB.!? \n`#-1[C]", max_size=120))
def test_sentence_spans_are_ordered(text):
    spans = A.sentence_spans(text)
    assert all(0 <= a < b <= len(text) and text[a:b] == text[a:b].strip() for a, b, _ in spans)
    assert all(b <= c for (_, b, _), (c, _, _) in zip(spans, spans[1:], strict=False))


def test_tables_headings_and_equations():
    assert A.tables("| a | b |\n|-|-|\n| 1 | 2 |\n") == [(0, "", ["a", "b"], [["1", "2"]])]
    assert A.tables("a,b,c\n1,2\n") == [] and A.tables("") == []
    assert [h[1] for h in A.infer_headings("1 Intro\nx.\nReferences\nMETHODS HERE\nAppendix\nMethod\n")] == ["Intro", "References", "Appendix", "Method"]
    found = A.equations("$$a=b$$ then $c$\n```\nx = y z\n```\nu = v + w (4)")
    assert [(e[2], e[3]) for e in found] == [("", "$$a=b$$"), ("", "$c$"), ("4", "u = v + w (4)")]
    assert A.symbols(r"\alpha_t + \frac{x_i}{y} = β") == [r"\alpha_t", "x_i", "y", "β"]


def test_citation_repair():
    assert A.repair_citations("a [c01][C2, C9] [C2]", ["C1", "C2"]) == ("a [C1] [C2] [C9]", ["C1", "C2", "C9"], ["C9"])
    assert A.repair_citations("none [x]", []) == ("none [x]", [], [])


def test_quoted_blocks():
    assert A.quoted_blocks("The quick  BROWN fox jumps over", "xx the quick brown fox jumps yy", 20) == (26, 26)
    assert A.quoted_blocks("", None) == (0, 0)


def test_rerank_takes_redundancy_off(spark):
    rows = [(1, 1, 1.0, ["a", "b"]), (1, 2, 0.9, ["a", "b"]), (1, 3, 0.5, ["c"])]
    got = A.redundancy_rerank(spark.createDataFrame(rows, "query_id long, doc_id long, score double, terms array<string>")).orderBy("position").collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 1.0), (3, 0.5), (2, 0.4)]


def test_extractive_answer(spark):
    evidence = spark.createDataFrame([(1, 1, 10, 2.0, "Cats sleep all day. Dogs bark loudly. Cats sleep all day."), (1, 2, 11, 1.0, "# Dogs\nDogs and cats differ.")], "query_id long, rank long, doc_id long, score double, text string")
    questions = spark.createDataFrame([(1, "do cats sleep and dogs bark")], "query_id long, text string")
    got = A.select_sentences(A.scored_sentences(evidence, questions)).orderBy("position").collect()
    assert [(r.label, r.start) for r in got] == [("C1", 20), ("C1", 0)]  # its terms are denser


def test_latent_dimensions_are_those_of_numpy(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"t{k}w{x}" for x in rng.integers(0, 12, 30)) + f" common{rng.integers(0, 5)}" for k in range(3) for _ in range(8)]
    terms = tokenized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    docs, vectors, values = L.fit(terms, 3)
    rows = L.weights(terms).collect()
    names = sorted({r.term for r in rows})
    a = np.zeros((len(texts), len(names)))
    for r in rows:
        a[r.doc_id, names.index(r.term)] = r.w
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values, s[:3], rtol=1e-3)
    want = (u[:, :3] * s[:3]) / np.linalg.norm(u[:, :3] * s[:3], axis=1, keepdims=True)
    got = np.array([r.v for r in docs.orderBy("doc_id").collect()])
    assert np.allclose(np.abs((got * want).sum(axis=1)), 1, atol=0.05) or np.allclose(got @ got.T, want @ want.T, atol=0.05)
