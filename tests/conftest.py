import json

import pytest
from pyspark.sql import SparkSession

from rosterlens import Domain, Lexicon


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lexicon():
    return Lexicon((
        Domain("ai_ml", "AI/ML", ("ai engineer", "machine learning", "computer vision"),
               ("machine learning", "embedding", "embeddings", "ranking", "retrieval", "nlp")),
        Domain("software", "software engineering", ("software engineer", "developer"),
               ("api", "rest api", "react native", "react", "database")),
        Domain("marketing", "marketing", ("marketing",), ("campaign", "seo", "stakeholder")),
        Domain("pm", "project/product management", ("product manager",),
               ("roadmap", "stakeholder", "scrum")),
    ))


ROLE_TEXT = """Job Description: Lead AI Engineer
Where: Pune or Noida, India
Experience: 5–9 years

You build ranking and retrieval systems with embeddings. NLP helps.

We do NOT want:
- pure computer vision or speech people.
- Marketing profiles.
"""


def person(number, **changes):
    """A nested record; ``changes`` replace whole top-level or profile fields."""
    record = {
        "candidate_id": f"CAND_{number:07d}",
        "profile": {"headline": "Engineer", "summary": "Builds things",
                    "current_title": "AI Engineer", "current_industry": "Software",
                    "current_company": "Acme", "years_of_experience": 7,
                    "location": "Pune", "country": "India"},
        "career_history": [
            {"title": "AI Engineer", "description": "ranking and retrieval", "industry": "Software",
             "company": "Acme", "is_current": True, "duration_months": 40,
             "start_date": "2022-01-01", "end_date": None},
            {"title": "Software Engineer", "description": "rest api work", "industry": "Fintech",
             "company": "Bank", "is_current": False, "duration_months": 40,
             "start_date": "2018-01-01", "end_date": "2021-12-01"}],
        "skills": [{"name": "NLP", "proficiency": "expert", "duration_months": 24}],
        "education": [{"field_of_study": "Physics"}],
        "signals": {"willing_to_relocate": True, "open_to_work_flag": True,
                    "verified_email": True, "verified_phone": False,
                    "recruiter_response_rate": 0.6, "interview_completion_rate": 0.8,
                    "last_active_date": "2026-06-01", "notice_period_days": 30,
                    "profile_completeness_score": 90, "github_activity_score": 80,
                    "skill_assessment_scores": {"NLP": 90, "React": 50}},
    }
    for key, value in changes.items():
        target = record if key in record else record["profile"]
        target[key] = value
    return record


def write_lines(path, records):
    path.write_text("\n".join(
        r if isinstance(r, str) else json.dumps(r) for r in records) + "\n", encoding="utf-8")
    return str(path)
