"""Facts: one flat row per candidate with everything the scores read.

Two providers give the same columns:

* :func:`nested_facts` folds the arrays of a nested record inside its row;
* :func:`table_facts` joins what child tables (roles, skills, assessments) give per
  candidate. Counts and sums are combined in every task before the shuffle, roles that must
  meet their owner are merged by duration first (:func:`role_facts`), so a candidate that owns
  a third of all child rows is no bottleneck, and no child list is ever collected.

``row_id`` is unique per row; ``candidate_id`` may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterlens.functions import integrity
from rosterlens.functions.basics import flag, let, lower_text, number, strings
from rosterlens.functions.lexicon import no_hits, title_hits
from rosterlens.functions.prose import candidate_prose
from rosterlens.functions.scores import bare_name, employer_class, keyword_match
from rosterlens.settings import JobSpec, Lexicon, Settings

CLASSES = ("consulting", "product", "nontech")
OVERLONG = "struct<title:string,months:double>"
MISDATED = "struct<title:string,months:double,span:int>"


def _count(array: Column) -> Column:
    return F.size(array).cast("bigint")


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def _or_empty(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.array().cast(f"array<{kind}>"))


def counted_skills(skills: Column, keywords: tuple[str, ...]) -> Column:
    """``(name, n)`` of skills that some role asks for, and how often each is listed."""
    names = F.filter(F.transform(skills, lambda k: bare_name(k["name"])),
                     lambda n: F.array_contains(strings(keywords), n))
    return let(names, lambda held: F.transform(F.array_distinct(held), lambda n: F.struct(
        n.alias("name"), _count(F.filter(held, lambda x: x == n)).alias("n"))))


def named_scores(scores: Column, keywords: tuple[str, ...]) -> Column:
    """``(name, score)`` of assessments that some role asks for."""
    pairs = F.transform(F.map_entries(scores), lambda e: F.struct(
        bare_name(e["key"]).alias("name"), e["value"].alias("score")))
    return F.coalesce(F.filter(pairs, lambda e: F.array_contains(strings(keywords), e["name"])),
                      F.array().cast("array<struct<name:string,score:double>>"))


def rated(asked: Column) -> tuple[Column, Column]:
    """Count and sum of the scores in ``assessed`` whose names are asked for.

    It holds names that some role asks for, each once, and is no longer than the keywords.
    """
    found = F.filter("assessed", lambda e: F.array_contains(asked, e["name"]) & e["score"].isNotNull())
    return _count(found), _total(F.transform(found, lambda e: e["score"]))


def nested_facts(candidates: DataFrame, spec: JobSpec, lexicon: Lexicon,
                 settings: Settings, keywords: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of nested candidate records. No shuffle.

    With ``keywords``, those of many roles, there are also ``skill_counts`` and ``assessed``, from
    which ``role_block`` takes what depends on the role.

    ``row_id`` is drawn here, so keep the result (:func:`materialise`) before
    it is read twice.
    """
    kinds = {f.name: f.dataType for f in candidates.schema}
    typed = candidates.withColumns({
        name: F.coalesce(F.col(name), F.array().cast(kinds[name]))
        for name in ("career_history", "skills", "education")})
    p, s = F.col("profile"), F.col("signals")
    roles, skills = F.col("career_history"), F.col("skills")
    yoe = p["years_of_experience"]
    past = F.filter(roles, lambda r: ~flag(r["is_current"]))

    counted = F.aggregate(
        F.transform(roles, lambda r: employer_class(r["company"], r["industry"], settings)),
        F.struct(*[F.lit(0).cast("bigint").alias(c) for c in CLASSES]),
        lambda acc, kind: F.struct(*[
            (acc[c] + (kind == c).cast("bigint")).alias(c) for c in CLASSES]))
    hits = F.aggregate(
        F.transform(past, lambda r: lower_text(r["title"])), no_hits(lexicon),
        lambda acc, t: F.zip_with(acc, title_hits(t, lexicon), lambda a, b: a + b))
    too_long = F.filter(roles, lambda r: integrity.overlong(r["duration_months"], yoe))
    dated = F.transform(roles, lambda r: F.struct(
        F.coalesce(r["title"], F.lit("?")).alias("title"),
        number(r["duration_months"]).alias("months"),
        integrity.span_months(r["start_date"], r["end_date"]).alias("span")))
    off_dates = F.filter(dated, lambda r: integrity.misdated(r["months"], r["span"]))
    scores = s["skill_assessment_scores"]
    relevant = F.map_values(F.map_filter(scores, lambda k, _: keyword_match(k, spec)))
    every = F.map_values(scores)

    def first_role(r: Column) -> Column:
        return F.when(r.isNotNull(), F.struct(
            F.coalesce(r["title"], F.lit("?")).alias("title"),
            number(r["duration_months"]).alias("months"))).cast(OVERLONG)

    return typed.select(
        F.monotonically_increasing_id().alias("row_id"), "candidate_id",
        p["current_title"].alias("title"), p["current_industry"].alias("industry"),
        p["current_company"].alias("company"), yoe.alias("yoe"),
        p["location"].alias("location"), p["country"].alias("country"),
        flag(s["willing_to_relocate"]).alias("relocate"),
        flag(s["open_to_work_flag"]).alias("open_to_work"),
        flag(s["verified_email"]).alias("email_ok"),
        flag(s["verified_phone"]).alias("phone_ok"),
        s["recruiter_response_rate"].alias("response_rate"),
        s["interview_completion_rate"].alias("interview_rate"),
        s["last_active_date"].alias("last_active"),
        s["notice_period_days"].alias("notice_days"),
        s["profile_completeness_score"].alias("completeness"),
        s["github_activity_score"].alias("github"),
        candidate_prose(p, roles, F.col("education")).alias("prose"),
        _count(roles).alias("n_roles"),
        let(counted, lambda c: c).alias("_classes"),
        _count(past).alias("n_completed"),
        _total(F.transform(past, lambda r: number(r["duration_months"]))).alias("completed_months"),
        _total(F.transform(roles, lambda r: number(r["duration_months"]))).alias("total_months"),
        hits.alias("past_hits"),
        let(F.get(too_long, F.lit(0)), first_role).alias("overlong"),
        F.get(off_dates, F.lit(0)).cast(MISDATED).alias("misdated"),
        _count(F.filter(skills, lambda k: keyword_match(k["name"], spec))).alias("skill_hits"),
        _count(F.filter(skills, lambda k: integrity.idle_mastery(
            k["proficiency"], k["duration_months"]))).alias("mastery_zero"),
        F.coalesce(_count(relevant), F.lit(0).cast("bigint")).alias("rel_n"),
        _total(_or_empty(relevant, "double")).alias("rel_sum"),
        F.coalesce(_count(every), F.lit(0).cast("bigint")).alias("all_n"),
        _total(_or_empty(every, "double")).alias("all_sum"),
        *([] if keywords is None else [
            counted_skills(skills, keywords).alias("skill_counts"),
            named_scores(scores, keywords).alias("assessed")]),
    ).select("*", *[F.col(f"_classes.{c}").alias(f"n_{c}") for c in CLASSES]).drop("_classes")


def _tally(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def role_facts(roles: DataFrame, owners: DataFrame, lexicon: Lexicon, settings: Settings,
               sums: tuple[str, ...] = (), latest: tuple[str, ...] = ()) -> DataFrame:
    """Facts of role rows per owner, in two steps, so that a hot owner is no hot task.

    ``roles`` are ``row_id role_no title company industry is_current duration_months start_year
    end_year`` and the columns of ``sums`` (added up) and ``latest`` (the largest is kept);
    ``owners`` are ``row_id yoe``. Whether a role is too long depends on its owner. So roles are
    first merged by owner and duration, without their owner: of equally long roles, all or none
    are too long, and only the first of them can be the one that is named. Durations are months:
    what is left of an owner is one row for each month count, however many roles there were.
    """
    return _per_owner(_per_duration(roles, lexicon, settings, sums, latest), owners, lexicon,
                      sums, latest)


def _per_duration(roles: DataFrame, lexicon: Lexicon, settings: Settings, sums, latest):
    months = number(F.col("duration_months"))
    done = ~flag(F.col("is_current"))
    marked = roles.withColumns({
        "_kind": employer_class(F.col("company"), F.col("industry"), settings),
        "_hits": title_hits(lower_text(F.col("title")), lexicon),
        "_done": done, "_months": months,
        "_span": ((F.nullif(F.col("end_year"), F.lit(0))
                   - F.nullif(F.col("start_year"), F.lit(0))) * 12).cast("int")})
    entry = F.struct("role_no", F.coalesce("title", F.lit("?")).alias("title"),
                     F.col("_months").alias("months"), F.col("_span").alias("span"))
    return marked.groupBy("row_id", "_months").agg(
        F.count(F.lit(1)).alias("n_roles"),
        *[_tally(F.col("_kind") == c).alias(f"n_{c}") for c in CLASSES],
        _tally(F.col("_done")).alias("n_completed"),
        *[F.sum(F.when(F.col("_done"), F.get("_hits", F.lit(i))).otherwise(0)).alias(f"_past_{i}")
          for i in range(len(lexicon.domains))],
        F.min(entry).alias("_first"),
        F.min(F.when(integrity.misdated(F.col("_months"), F.col("_span")), entry)).alias("_off"),
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in latest])


def _per_owner(merged: DataFrame, owners: DataFrame, lexicon: Lexicon, sums, latest):
    past = [f"_past_{i}" for i in range(len(lexicon.domains))]
    months, long, off = F.col("_months"), F.col("_long"), F.col("_off")
    added = ("n_roles", *[f"n_{c}" for c in CLASSES], "n_completed", *sums)
    too_long = F.min(F.when(integrity.overlong(months, F.col("yoe")), F.col("_first")))
    owned = merged.join(owners.select("row_id", "yoe"), "row_id").groupBy("row_id").agg(
        *[F.sum(c).alias(c) for c in added], *[F.sum(c).cast("int").alias(c) for c in past],
        F.sum(F.col("n_completed") * months).alias("completed_months"),
        F.sum(F.col("n_roles") * months).alias("total_months"),
        too_long.alias("_long"), F.min("_off").alias("_off"),
        *[F.max(c).alias(c) for c in latest])
    return owned.withColumns({
        "past_hits": F.array(*[F.col(n) for n in past]),
        "overlong": F.when(long.isNotNull(), F.struct(
            long["title"].alias("title"), long["months"].alias("months"))).cast(OVERLONG),
        "misdated": F.when(off.isNotNull(), F.struct(
            off["title"].alias("title"), off["months"].alias("months"),
            off["span"].alias("span"))).cast(MISDATED),
    }).drop(*past, "_long", "_off")


def skill_aggregates(spec: JobSpec) -> list[Column]:
    """Aggregates over skill rows: ``name proficiency duration_months``."""
    return [_tally(keyword_match(F.col("name"), spec)).alias("skill_hits"),
            _tally(integrity.idle_mastery(F.col("proficiency"), F.col("duration_months"))
                   ).alias("mastery_zero")]


def assessment_aggregates(spec: JobSpec) -> list[Column]:
    """Aggregates over assessment rows: ``name score``."""
    relevant = keyword_match(F.col("name"), spec) & F.col("score").isNotNull()
    return [_tally(relevant).alias("rel_n"),
            F.sum(F.when(relevant, F.col("score")).otherwise(0.0)).alias("rel_sum"),
            F.count("score").alias("all_n"),
            F.coalesce(F.sum("score"), F.lit(0.0)).alias("all_sum")]


ZERO_COUNTS = ("n_roles", "n_consulting", "n_product", "n_nontech", "n_completed",
               "skill_hits", "mastery_zero", "rel_n", "all_n")
ZERO_SUMS = ("completed_months", "total_months", "rel_sum", "all_sum")


def table_facts(people: DataFrame, children: list[DataFrame], key: str,
                lexicon: Lexicon) -> DataFrame:
    """Join per-candidate aggregates to the people table; absent means zero."""
    df = people
    for child in children:
        df = df.join(child, key, "left")
    present = set(df.columns)
    fill = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ZERO_COUNTS if c in present}
    fill |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ZERO_SUMS if c in present}
    fill |= {c: F.coalesce(c, no_hits(lexicon)) for c in ("past_hits", "term_hits")
             if c in present}
    for name, kind in (("found", "string"), ("skill_counts", "struct<name:string,n:bigint>"),
                       ("assessed", "struct<name:string,score:double>")):
        if name in present:
            fill[name] = _or_empty(F.col(name), kind)
    return df.withColumns(fill)
