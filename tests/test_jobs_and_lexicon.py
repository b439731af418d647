import itertools
import re

from conftest import ROLE_TEXT
from helpers import c, evaluate, same
from pyspark.sql import functions as F

from rosterlens import Domain, Lexicon, Settings
from rosterlens.functions import lexicon as lx
from rosterlens.operators import jobs

S = Settings()


def test_title(spark):
    rows = [("\n  \n Job  Description :  Data Lead \nmore",), ("Plain first line\nRole: no",),
            ("We hire. Position - Cook",), ("  \n ",), ("x" * 200,)]
    assert evaluate(spark, "t STRING", rows, jobs.title(c("t"), Settings())) == [
        "Data Lead", "Plain first line", "Cook", "", "x" * 120]


def test_experience_band(spark):
    rows = [("5-9 years",), ("3 to 7+ Years",), ("5 – 9 years",), ("minimum 4 years",),
            ("at least 3+ years",), ("6+ years",), ("10 years",), ("1 year",), ("none",),
            ("8 years, later 2-3 years",)]
    got = evaluate(spark, "t STRING", rows, jobs.experience_band(c("t")))
    assert [tuple(g) for g in got] == [
        (5, 9, 7), (3, 7, 5), (5, 9, 7), (4, 10, 5), (3, 9, 4), (6, 12, 7), (8, 13, 10),
        (0, 4, 1), (0, 50, 0), (2, 3, 2.5)]


def test_places_are_whole_words(spark):
    rows = [("Based in New Delhi or Pune",), ("Punekar",)]
    assert evaluate(spark, "t STRING", rows, jobs.places(c("t"), S.cities)) == [
        ["delhi", "new delhi", "pune"], []]
    assert evaluate(spark, "t STRING", [("UK, not Ukraine",), ("Ukraine",)],
                    jobs.places(c("t"), S.countries)) == [["uk"], []]


def test_exclusion_window(spark):
    far = "We do not want this. " + "x. " * 14 + "robotics. speech."
    again = "avoid a. " + "x. " * 10 + "not a fit b. " + "x. " * 14 + "vision. speech"
    rows = [(far,), (again,), ("robotics and speech",), ("We will NOT take sales; or marketing",),
            ("bad fit: computer vision",)]
    # the first marker and the 15 clauses after it; "speech" is the 16th
    assert evaluate(spark, "t STRING", rows, jobs.exclusions(c("t"), S)) == [
        ["robotics"], ["vision"], [], ["sales", "marketing"], ["computer vision", "vision"]]


def test_whole_spec(spark, lexicon):
    spec = jobs.parse_job(spark, ROLE_TEXT, lexicon, S)
    assert spec.title == "Lead AI Engineer"
    assert (spec.exp_min, spec.exp_max, spec.exp_ideal) == (5, 9, 7)
    assert spec.cities == ("noida", "pune") and spec.countries == ("india",)
    assert spec.excluded == ("computer vision", "vision", "speech", "marketing")
    assert spec.target_domains == ("ai_ml",)
    # "computer vision" is a title phrase of the domain but excluded
    assert spec.keywords == ("embedding", "embeddings", "ranking", "retrieval", "nlp",
                             "ai engineer")


def test_spec_without_any_domain_targets_the_first(spark, lexicon):
    spec = jobs.parse_job(spark, "Cook", lexicon, S)
    assert spec.target_domains == ("ai_ml",) and spec.keywords == () and set(spec.vector) == {0.0}


def test_spec_view(spark, lexicon):
    df = spark.createDataFrame([(1, ROLE_TEXT), (2, "Cook")], "jd_id INT, text STRING")
    rows = jobs.spec_view(jobs.job_specs(df, lexicon, S), lexicon).orderBy("jd_id").collect()
    assert rows[0]["role_domain"] == "AI/ML" and rows[0]["experience"] == "5–9 yrs"
    assert rows[0]["places"] == "noida, pune"
    assert (rows[1]["experience"], rows[1]["places"], rows[1]["key_terms"]) == ("any", "any", "—")


def test_terms_longest_first_without_overlap(spark, lexicon):
    rows = [("a rest api in react native",), ("react, api",), ("rapid reactor",),
            ("embeddings embedding",)]
    assert evaluate(spark, "t STRING", rows, lx.matched_terms(c("t"), lexicon)) == [
        ["rest api", "react native"], ["react", "api"], [], ["embeddings", "embedding"]]


def test_shared_prefix_pattern_equals_sorted_alternation():
    terms = ["api", "rest api", "react", "react native", "ci/cd", "c", "node.js", "node", "a.i"]
    plain = re.compile(r"(?<![a-z0-9])(" + "|".join(
        re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")(?![a-z0-9])")
    folded = re.compile(lx.term_pattern(terms))
    for text in ("rest api", "react native", "react nativex", "ci/cd c", "node.jsx node.js nodes",
                 "a.i ai", "api.rest api", "xreact react-native", "c/c ci"):
        assert plain.findall(text) == folded.findall(text)


def test_domain_vector(spark, lexicon):
    rows = [("ai engineer", [0, 1, 0, 0], "stakeholder api database"), ("", [0, 0, 0, 0], "")]
    got = evaluate(spark, "t STRING, p ARRAY<INT>, x STRING", rows,
                   lx.domain_vector(c("t"), c("p"), lx.text_hits(c("x"), lexicon), lexicon))
    norm = (16 + 1.8 ** 2 + 0.4 ** 2 + 0.4 ** 2) ** 0.5
    assert same(got[0], [4 / norm, 1.8 / norm, 0.4 / norm, 0.4 / norm])
    assert got[1] == [0.0] * 4


def test_term_credit_is_capped(spark, lexicon):
    text = "machine learning embedding embeddings ranking retrieval nlp"
    got = evaluate(spark, "x STRING", [(text,)], lx.term_counts(
        lx.matched_terms(c("x"), lexicon), lexicon))
    assert got == [[6, 0, 0, 0]]


def test_top_domains_slice_then_threshold_ties_by_order(spark, lexicon):
    rows = [([0.5, 0.5, 0.5, 0.5],), ([0.1, 0.9, 0.2, 0.0],), ([0.0, 0.0, 0.0, 0.0],)]
    assert evaluate(spark, "v ARRAY<DOUBLE>", rows, lx.top_domains(c("v"), lexicon, 2, 0.2)) == [
        ["ai_ml", "software"], ["software", "marketing"], []]
    assert evaluate(spark, "v ARRAY<DOUBLE>", rows, lx.top_domains(c("v"), lexicon, 1, 0.0)) == [
        ["ai_ml"], ["software"], ["ai_ml"]]


def test_lexicon_from_table(spark, lexicon):
    rows = [(i, d.name, d.label, k, j, p) for i, d in enumerate(lexicon.domains)
            for k, words in (("title", d.titles), ("term", d.terms)) for j, p in enumerate(words)]
    table = spark.createDataFrame(
        rows, "domain_idx INT, domain STRING, label STRING, kind STRING, phrase_idx INT, phrase STRING")
    assert type(lexicon).from_frame(table.orderBy("phrase")) == lexicon


def test_shortest_branches_tell_whether_a_phrase_is_contained():
    phrases = {"ai", "ai engineer", "data", "database", "c++", "dev"}
    folded = re.compile(lx._branches(phrases, shortest=True))
    for text in ("retail", "database admin", "c++", "c+", "", "engineer", "ai engineer", "devops"):
        assert bool(folded.search(text)) == any(p in text for p in phrases)


def big_lexicon(phrases):
    """A lexicon of two domains whose phrases are made by rule."""
    names = [f"{a}{b} {c}{i}x" for i, (a, b, c) in enumerate(itertools.islice(
        itertools.cycle(itertools.product("bcdfgh", "aeiou", "klmnp")), phrases))]
    half = len(names) // 2
    return Lexicon((Domain("one", "One", tuple(names[:half]), tuple(names[:half])),
                    Domain("two", "Two", tuple(names[half:]), tuple(names[half:]))),
                   frozenset({"one"}))


def test_a_hundred_thousand_phrases(spark):
    lexicon = big_lexicon(50_000)   # each a title phrase and a term
    first, last = lexicon.domains[0].terms[7], lexicon.domains[1].terms[-1]
    rows = [(f"senior {first} person", f"knows {first} and {last}, {last}"), ("none", "none")]
    got = evaluate(spark, "t STRING, x STRING", rows, F.struct(
        lx.title_hits(c("t"), lexicon).alias("t"), lx.text_hits(c("x"), lexicon).alias("x")))
    assert [tuple(r) for r in got] == [([1, 0], [1, 1]), ([0, 0], [0, 0])]
    other = lexicon.domains[1].terms[-2]
    spec = jobs.parse_job(spark, f"Role: {first}\nuses {last}, {other}", lexicon, Settings())
    assert spec.keywords == (first, other, last) and spec.target_domains == ("one", "two")
