"""Scalar functions against plain restatements and fixed cases."""

import random
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from folioforge.functions import similarity as sim
from folioforge.functions import text as tx
from folioforge.functions.stem import stem


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_arxiv_id(spark):
    got = apply(spark, tx.arxiv_id, ["2301.11167", "2301.11167v3", "https://arxiv.org/abs/2301.11167v2", "not-an-arxiv-id", "123.456", "12345.678901"])
    assert got == ["2301.11167", "2301.11167", "2301.11167", "", "", "2345.67890"]
    assert apply(spark, tx.is_arxiv_id, ["2301.11167v2", "x2301.11167", "", None]) == [True, False, False, False]


def test_doi_and_bare_id(spark):
    assert apply(spark, tx.doi, ["see 10.1000/abc. and", "none"]) == ["10.1000/abc.", ""]
    assert apply(spark, tx.bare_id, ["solv-int/9901001v2", "2301.00001v11", "cs/0101"]) == ["9901001", "2301.00001", "0101"]
    assert apply(spark, tx.arxiv_year, ["2301.1", "9912.1", "ab", ""]) == [2023, 2099, 0, 0]


def test_normalized_title(spark):
    cases = ["Foo,  Bar... Baz!", "R.A.G.", "   \t\n  ", "", None, "Éa-b_c  Ü"]
    assert apply(spark, tx.normalized_title, cases) == ["foo bar baz", "rag", "", "", "", "éab_c ü"]
    assert [sim.normalized(x) for x in cases] == ["foo bar baz", "rag", "", "", "", "éab_c ü"]
    assert sim.ratio("R.A.G.", "RAG") >= 0.7 and sim.ratio("alpha beta gamma", "xyz qrs uvw") < 0.3
    assert sim.ratio("tide", "diet") != sim.ratio("diet", "tide")


def grams(x):
    x = re.sub(r"[^a-z0-9\s]", "", x.lower().strip())
    return {x[i : i + 3] for i in range(len(x) - 2)}


def test_trigram_jaccard_against_sets(spark):
    rnd = random.Random(3)
    pairs = [("".join(rnd.choice("abc dE-1") for _ in range(rnd.randint(0, 14))), "".join(rnd.choice("abc dE-1") for _ in range(rnd.randint(0, 14)))) for _ in range(200)]
    pairs += [("Fourier Neural Operator for PDEs", "Fourier Neural Operator for Partial Differential Equations"), ("Quantum Physics", "Weather Forecasting")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in rows.select("i", tx.jaccard(tx.trigrams(F.col("a")), tx.trigrams(F.col("b"))).alias("s")).orderBy("i").select("s").collect()]
    for (a, b), s in zip(pairs, got, strict=True):
        x, y = grams(a), grams(b)
        assert s == pytest.approx(len(x & y) / len(x | y) if x and y else 0.0)
    assert 0.3 < got[-2] <= 1 and got[-1] < 0.5


def test_relevance(spark):
    rows = spark.createDataFrame([("Fourier Neural Operator for Parametric PDEs", "We learn neural operators"), ("Quantum Entanglement in Spin Systems", "a pde"), (None, None)], "t string, a string")
    r = tx.relevance(F.col("t"), F.col("a"), high=["neural operator", "pde"], excluded=["quantum", "llm"])
    assert [x[0] for x in rows.select(r).collect()] == [40, 0, 0]
    many = tx.relevance(F.lit("a b c d"), F.lit(""), high=["a", "b", "c"], phrases=["a b", "b c", "c d", "a", "b", "c"])
    assert rows.select(many).first()[0] == 60
    assert rows.select(tx.relevance(F.lit("a"), F.lit(""), high=["a"], phrases=["a"] * 6)).first()[0] == 80


def test_years_and_categories(spark):
    assert apply(spark, lambda x: tx.in_years(x, 2018, 2020), ["2019-01-01", "2017-12-31", "2021", "", "abcd"]) == [True, False, False, True, True]
    assert apply(spark, lambda x: tx.has_category(x, ["cs.LG"]), ["cs.LG math", " math  cs.LG ", "cs.lg", "cs.LGX"]) == [True, True, False, False]


def test_small_formulas(spark):
    assert apply(spark, lambda x: tx.human_bytes(x), ["4.5G", "12 KiB", "300", "x", "1MB"]) == [4831838208, 12288, 300, None, 1048576]
    assert apply(spark, lambda x: tx.backoff(x, 2.0, 10.0), [1, 2, 3, 9], "int") == [2.0, 4.0, 8.0, 10.0]
    assert apply(spark, lambda x: tx.code_level(x), [5, 10, 100], "int") == [3, 4, 5]
    assert apply(spark, tx.status_of, [0.7, 0.4, 0.39], "double") == ["VERIFIED", "SUSPECTED", "NOT_FOUND"]
    assert apply(spark, lambda x: tx.progress(x, F.lit(10)), [10, 5, 0], "int") == [99, 50, 0]
    assert apply(spark, lambda x: tx.progress(x, F.lit(0)), [1], "int") == [0]
    assert apply(spark, tx.date_range_parts, ["a:b", "a", "a:b:c"]) == [["a", "b"], None, None]
    assert apply(spark, lambda x: tx.venue_year(x, F.lit(2020)), ["J", "", None]) == ["J (2020)", "", ""]
    assert apply(spark, lambda x: tx.venue_year(x, F.lit(None).cast("int")), ["J"]) == ["J"]
    assert apply(spark, tx.keywords, ["Deep Deep Fourier PDE ab x Net"]) == [["Fourier", "Deep", "Net", "PDE"]]


def test_confidences(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(tx.confidence_europepmc(F.lit("d"), F.lit("Y"), F.lit(42))) == pytest.approx(1.0)
    assert get(tx.confidence_europepmc(F.lit("d"), F.lit("N"), F.lit(15))) == pytest.approx(0.75)
    assert get(tx.confidence_s2(F.lit("d"), F.lit("a"), F.lit("p"), F.lit(88))) == pytest.approx(1.0)
    assert get(tx.confidence_s2(F.lit("d"), F.lit(""), F.lit(""), F.lit(40))) == pytest.approx(0.6)


def test_github_links(spark):
    cases = [
        'x <a href="https://github.com/a/b"><img src=s></a> https://github.com/c/d', "see https://github.com/a/digit.git now", '<a class="x code y" href="https://e.org/r">',
        '<div class="code-links"><a href="https://gitlab.com/q/r">', "none",
    ]
    assert apply(spark, tx.github_url, cases) == ["https://github.com/a/b", "https://github.com/a/digit", "", "", ""]
    more = ['see GitHub.com/a/b/tree/x/ <A HREF="https://github.com/c/d.git"> code </A>', '<a class="code" href="https://x.github.io/y/">', '<div class="code-links">www.github.com/q/r, s</div>', "github.com/alone"]
    assert apply(spark, tx.github_url, more) == ["https://github.com/c/d", "https://x.github.io/y", "https://github.com/q/r", ""]
    assert apply(spark, tx.hosted_code_url, ["https://gitlab.com/a/b", "x"]) == ["https://github.com/a/b", ""]


def test_citations(spark):
    text = 'The FNO paper (arXiv:2010.08895) and arXiv:1711.10561v2. "A long title" (Li et al., 2020) and Raissi et al. (2019) "Physics-informed neural networks".'
    got = [tuple(x) for x in apply(spark, tx.citations, [text])[0]]
    assert got == [
        ("arxiv", "2010.08895", "", 0, ""), ("arxiv", "1711.10561", "", 0, ""), ("author-year-title", "", "Li et al.", 2020, "A long title"),
        ("author-year-title", "", "Raissi et al.", 2019, "Physics-informed neural networks"),
    ]


def test_snowflake(spark):
    now = int(datetime(2026, 1, 2, tzinfo=timezone.utc).timestamp() * 1000)
    triples = [(now + i, i % 64, 5 + i % 59) for i in range(200)]
    rows = spark.createDataFrame(triples, "ms long, w long, s long").withColumn("id", tx.snowflake(F.col("ms"), F.col("w"), F.col("s")))
    for r in rows.select("*", tx.snowflake_ms(F.col("id")).alias("a"), tx.snowflake_worker(F.col("id")).alias("b"), tx.snowflake_sequence(F.col("id")).alias("c")).collect():
        assert r["id"] == ((r["ms"] - 1728000000000) << 12) + (r["w"] << 6) + r["s"]
        assert (r["a"], r["b"], r["c"]) == (r["ms"], r["w"], r["s"])


def test_nested_text(spark):
    f = lambda x: tx.nested_text(x, "title")
    assert apply(spark, f, ['{"title":"Paper Title"}', '{"title":{"value":"Nested Title"}}', '{"title":{"content":"C"}}', "{}"]) == ["Paper Title", "Nested Title", "C", ""]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("formalize", "formal"), ("replacement", "replac"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"), ("happy", "happi"), ("digitizer", "digit"), ("adoption", "adopt")])
def test_stem(word, want):
    assert stem(word) == want


def test_citation_score():
    assert sim.citation_score("Fourier Neural Operator", "Fourier Neural Operator", 2020, 2020, "Li", "Zongyi Li") == 1.0
    assert sim.citation_score("a b c", "x y z", 0, 2020, "", "") < 0.4


def test_cosine(spark):
    one = spark.createDataFrame([([0.1, 0.2, 0.3], [0.1, 0.2, 0.3], [0.0, 0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = one.select(sim.dot(F.col("a"), F.col("b")), sim.cosine(F.col("a"), F.col("b")), sim.cosine(F.col("a"), F.col("z"))).first()
    assert r[0] == pytest.approx(0.14) and r[1] == pytest.approx(1.0) and r[2] == 0.0


def test_ratio_of_a_contained_title_is_the_matchers(monkeypatch):
    """Also from the length on at which the matcher leaves out frequent characters; and it isn't asked where the answer is known."""
    import random
    from difflib import SequenceMatcher

    from folioforge.functions import similarity

    r = random.Random(1)
    made = lambda n: "".join(r.choice("ab c") for _ in range(n)).strip()
    known = 0
    for _ in range(2000):
        b = similarity.normalized(made(r.choice((0, 3, 40, 199, 230))))
        i = r.randrange(len(b) + 1)
        x = r.choice((b[i : i + r.randrange(60)], b + made(9), made(5)))
        assert similarity.ratio(x, b) == SequenceMatcher(None, similarity.normalized(x), b).ratio()
        known += similarity.normalized(x) in b
    assert known > 500
    monkeypatch.setattr(similarity, "SequenceMatcher", None)
    assert similarity.ratio("The word", "Of the word.") == 2 * 8 / 19
