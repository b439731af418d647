from helpers import c, evaluate, same, spec

from rosterlens import Settings
from rosterlens.functions import scores

S = Settings()


def test_experience_without_band_is_neutral(spark, lexicon):
    assert evaluate(spark, "y DOUBLE", [(3.0,), (None,)],
                    scores.experience(c("y"), spec())) == [0.7, 0.7]


def test_experience_inside_and_outside(spark):
    role = spec(exp_min=5.0, exp_max=9.0, exp_ideal=7.0)
    got = evaluate(spark, "y DOUBLE", [(7.0,), (5.0,), (9.0,), (8.0,), (4.0,), (10.0,), (30.0,),
                                       (None,)], scores.experience(c("y"), role))
    assert same(got, [1.0, 0.82, 0.82, 0.91, 0.67, 0.67, 0.08, 0.8 - 0.13 * 5])


def test_experience_narrow_band_uses_at_least_one_year(spark):
    role = spec(exp_min=5.0, exp_max=5.0, exp_ideal=5.0)
    assert same(evaluate(spark, "y DOUBLE", [(5.0,), (5.5,)], scores.experience(c("y"), role)),
                [1.0, 0.8 - 0.13 * 0.5])


def test_location_branches(spark):
    rows = [("Greater Pune", "India", False), ("Delhi", "India", True), ("Delhi", "India", False),
            ("Berlin", "Germany", True), ("Berlin", "Germany", False), (None, None, None)]
    def score(role):
        return evaluate(spark, "l STRING, k STRING, r BOOLEAN", rows,
                        scores.location(c("l"), c("k"), c("r"), role, S))
    assert score(spec()) == [0.7] * 6
    assert score(spec(cities=("pune",))) == [1.0, 0.78, 0.68, 0.35, 0.15, 0.15]
    assert score(spec(countries=("india",))) == [0.82, 0.82, 0.82, 0.35, 0.15, 0.15]
    assert score(spec(cities=("pune",), countries=("germany",))) == [1.0, 0.35, 0.15, 0.78, 0.68, 0.15]


def test_evidence(spark):
    role = spec(keywords=("nlp", "ai", "ranking"))
    found = scores.evidence_found(c("p"), role)
    rows = [("nlp and ranking at a retail firm",), ("nothing",), ("",)]
    assert evaluate(spark, "p STRING", rows, found) == [["nlp", "ai", "ranking"], [], []]
    assert same(evaluate(spark, "p STRING", rows, scores.evidence(found, role)), [0.6, 0.0, 0.0])
    assert evaluate(spark, "p STRING", rows, scores.evidence(found, spec())) == [0.5] * 3


def test_evidence_denominator_limits(spark):
    many = tuple(f"word{i:02d}" for i in range(40))
    role = spec(keywords=many)
    rows = [(" ".join(many[:10]),), (" ".join(many[:5]),)]
    found = scores.evidence_found(c("p"), role)
    assert same(evaluate(spark, "p STRING", rows, scores.evidence(found, role)), [1.0, 0.5])


def test_employer_class_precedence(spark):
    rows = [("TCS", "Software"), ("Acme", "Retail"), ("Acme", "Automotive"), (None, None),
            ("Acme", "IT Services")]
    # "retail" contains "ai", so the product list claims it first
    assert evaluate(spark, "a STRING, b STRING", rows, scores.employer_class(
        c("a"), c("b"), S)) == ["consulting", "product", "nontech", "other", "consulting"]


def test_company_type(spark, lexicon):
    rows = [(0, 0, 0, 0, "Software"), (0, 0, 0, 0, "Steel"), (2, 2, 0, 0, ""), (1, 1, 0, 0, ""),
            (5, 0, 0, 4, ""), (4, 0, 4, 0, ""), (5, 0, 1, 4, "")]
    score = scores.company_type(c("n"), c("co"), c("p"), c("t"), c("i"), spec(), lexicon, S)
    got = evaluate(spark, "n INT, co INT, p INT, t INT, i STRING", rows, score)
    assert same(got, [0.5, 0.3, 0.45 - 0.3 if 0.45 - 0.3 < 0.18 else 0.18, 0.45 - 0.3,
                      0.45 - 0.45 * 0.8, 1.0, 0.45 + 0.55 * 0.2 - 0.45 * 0.8])
    other = spec(target_domains=("marketing",))
    assert evaluate(spark, "n INT, co INT, p INT, t INT, i STRING", rows, scores.company_type(
        c("n"), c("co"), c("p"), c("t"), c("i"), other, lexicon, S)) == [0.65] * 7


def test_stuffing(spark):
    rows = [(3, 0.0), (4, 0.45), (4, 0.0), (8, 0.0), (16, 0.225)]
    assert same(evaluate(spark, "h INT, f DOUBLE", rows, scores.stuffing(c("h"), c("f"))),
                [1.0, 1.0, 1 - 0.45 * 0.5, 0.55, 1 - 0.45 * 0.5])


def test_excluded_specialty(spark):
    rows = [("Supervision Lead", 0.2), ("Vision Engineer", 0.9), ("Analyst", 0.0), (None, 0.0)]
    role = spec(excluded=("vision",))
    assert evaluate(spark, "t STRING, e DOUBLE", rows, scores.excluded_specialty(
        c("t"), c("e"), role)) == [0.6, 0.8, 1.0, 1.0]


def test_job_hopping(spark):
    rows = [(2, 2.0), (3, 45.0), (3, 48.0), (4, 79.0), (4, 80.0), (0, 0.0)]
    assert evaluate(spark, "n INT, m DOUBLE", rows, scores.job_hopping(c("n"), c("m"))) == \
        [1.0, 0.85, 1.0, 0.92, 1.0, 1.0]


def test_recency_buckets(spark):
    rows = [("2026-06-01",), ("2026-05-31",), ("2026-03-02",), ("2025-12-30",), ("2025-06-01",),
            ("2025-05-31",), (None,), ("soon",), ("2027-01-01",), ("2026",)]
    assert evaluate(spark, "d STRING", rows, scores.recency(c("d"), S)) == \
        [1.0, 1.0, 0.85, 0.6, 0.3, 0.12, 0.5, 0.5, 1.0, 0.5]


def test_availability_full_and_sparse(spark):
    names = "rr DOUBLE, la STRING, o BOOLEAN, i DOUBLE, n DOUBLE, k DOUBLE, e BOOLEAN, p BOOLEAN"
    rows = [(0.6, "2026-06-01", True, 1.0, 30.0, 90.0, True, True),
            (None, None, None, None, None, None, None, None),
            (0.3, "2026-06-01", False, 0.5, 60.0, 45.0, True, False)]
    got = evaluate(spark, names, rows, scores.availability(
        c("rr"), c("la"), c("o"), c("i"), c("n"), c("k"), c("e"), c("p"), S))
    sparse = (0.25 * 0.5 + 0.12 * 0.55) / (0.25 + 0.12 + 0.06)
    partial = 0.3 * 0.5 + 0.25 + 0.12 * 0.55 + 0.1 * 0.5 + 0.1 * 0.8 + 0.07 * 0.5 + 0.06 * 0.5
    assert same(got, [1.12, 0.55 + 0.57 * sparse, 0.55 + 0.57 * partial])


def test_corroboration(spark, lexicon):
    rows = [(90.0, 80.0), (20.0, 0.0), (None, -1.0), (None, None), (55.0, 35.0)]
    got = evaluate(spark, "m DOUBLE, g DOUBLE", rows, scores.corroboration(
        c("m"), c("g"), spec(), lexicon))
    assert same(got, [1.08, 1 - 0.025 - 0.009, 1.0, 1.0, 1.0])
    quiet = spec(target_domains=("marketing",))
    assert same(evaluate(spark, "m DOUBLE, g DOUBLE", rows, scores.corroboration(
        c("m"), c("g"), quiet, lexicon)), [1.05, 0.975, 1.0, 1.0, 1.0])


def test_assessment_mean_prefers_the_roles_skills(spark):
    rows = [(1, 80.0, 3, 120.0), (0, 0.0, 2, 100.0), (0, 0.0, 0, 0.0)]
    assert evaluate(spark, "a INT, b DOUBLE, d INT, e DOUBLE", rows, scores.assessment_mean(
        c("a"), c("b"), c("d"), c("e"))) == [80.0, 50.0, None]


def test_keyword_match_trims_and_folds_case(spark):
    role = spec(keywords=("nlp",))
    assert evaluate(spark, "n STRING", [(" NLP\t",), ("nlp tools",), (None,)],
                    scores.keyword_match(c("n"), role)) == [True, False, False]


def test_blend_falls_back(spark):
    assert evaluate(spark, "t DOUBLE, d DOUBLE", [(0.4, 0.8), (0.4, None), (0.4, -0.2)],
                    scores.blended(c("t"), c("d"))) == [0.6000000000000001, 0.4, 0.1]
