"""The registered queries: name -> (spark, sf_dir) -> DataFrame.

Results are flat (no nested columns), so that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright import schemas
from placewright.catalog import stubs
from placewright.catalog.views import Views
from placewright.functions import rules
from placewright.functions.core import computed_once
from placewright.functions.metadata import language_evidence, only_english
from placewright.functions.predicates import compatibility, literal_preferences
from placewright.functions.prompts import build_prompt
from placewright.functions.text import (
    EPOCH,
    as_bool,
    clean_text,
    csv_list,
    first_non_empty,
    is_approval,
    local_time,
    names_in_text,
    strip_fences,
)
from placewright.functions.vectors import l2_normalize
from placewright.operators import (
    compatibility as compat,
)
from placewright.operators import (
    enrich,
    folds,
    inference,
    ingest,
    keyed,
    reports,
    review,
    similarity,
)
from placewright.operators.gazetteer import with_names
from placewright.plans import rounds
from placewright.plans.ingest import run_embed_batch, run_extract_batch
from placewright.plans.match import match_resumes, search_width
from placewright.session import shared_folder
from placewright.sources import payloads, resumes, tables
from placewright.sources.buckets import BucketTable
from placewright.streaming.channel import HANDOFF, handoffs, incremental_handoffs
from placewright.streaming.incremental import (
    current_status,
    incremental_ingest,
    incremental_status,
    posting_table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Preferences used by the single-rule queries.
ONE_CANDIDATE = {
    "experience_years": 4,
    "must_have_skills": ["The", "en"],
    "preferred_locations": ["Europe", " "],
    "open_to_relocation": False,
    "requires_visa_sponsorship": True,
}
TITLE_PATTERNS = ["%intern%", "%part%", "%ring%", "%bolt%"]


def named(name: str) -> Callable:
    """Register a query under ``name``."""

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        return build

    return register


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register a query under the name of its function."""
    return named(build.__name__)(build)


# ---- sources, sinks, table state -------------------------------------------


@query
def parse_search_pages(v: Views) -> DataFrame:
    return payloads.parse_search_pages(v.search_pages)


@query
def parse_posting_details(v: Views) -> DataFrame:
    names = payloads.gazetteer_names(v.table("region").select(F.col("r_name").alias("name")))
    parsed = payloads.parse_posting_details(v.detail_payloads, names).postings
    return parsed.withColumn("posted_at", stamp(F.col("posted_at")))


@query
def ingest_new_ids(v: Views) -> DataFrame:
    return ingest.new_ids(v.texts.select("job_id"), v.arrivals)


@query
def ingest_postings(v: Views) -> DataFrame:
    known = v.texts.select("job_id")
    result = ingest.ingest_postings(known, v.arrivals, v.arrival_order)
    return result.inserted.select("job_id", "title", "company", "description")


@query
def upsert_metadata(v: Views) -> DataFrame:
    old = v.metadata.withColumn("seq", F.lit(0))
    new = enrich.flatten_metadata(
        enrich.validate_replies(v.replies).where("metadata IS NOT NULL")
    ).withColumn("seq", F.lit(1))
    return ingest.upsert(old, new)


@query
def bucketed_upsert(v: Views) -> DataFrame:
    """The same upsert on a bucket table: only buckets of arriving keys are rewritten."""
    stored = BucketTable(v.spark, shared_folder(v.spark, "metadata"), f"{schemas.METADATA}, seq INT")
    stored.append(v.metadata.withColumn("seq", F.lit(0)), 0)
    valid = enrich.validate_replies(v.replies).where("metadata IS NOT NULL")
    new = enrich.flatten_metadata(valid).withColumn("seq", F.lit(1))
    stored.merge(new, 1, lambda rows: ingest.latest_rows(rows, ["job_id"], [F.col("seq").desc()]))
    return stored.read()


@query
def exclude_titles(v: Views) -> DataFrame:
    kept = ingest.exclude_titles(v.postings, TITLE_PATTERNS).kept
    return kept.select("job_id", "title")


@query
def drop_closed(v: Views) -> DataFrame:
    states = payloads.posting_states(v.state_payloads)
    return ingest.drop_closed(v.postings, states).select("job_id", "title")


@query
def hydrate_hits(v: Views) -> DataFrame:
    return keyed.hydrate(v.pairs.select("candidate_id", "job_id"), v.postings)


@query
def metadata_lookup(v: Views) -> DataFrame:
    return keyed.metadata_lookup(v.pairs, v.metadata)


@query
def append_vectors(v: Views) -> DataFrame:
    """Stored vectors, then those of postings that had none."""
    table = shared_folder(v.spark, "vectors")
    tables.write_batch(v.vectors, table, 0)
    stored = run_embed_batch(v.spark, v.texts, table, 1, stubs.encoder)
    return stored.select(
        "job_id",
        F.size("embedding").alias("dimensions"),
        F.round(F.array_max("embedding").cast("double"), 5).alias("largest"),
    )


@query
def load_candidates(v: Views) -> DataFrame:
    """Every message as a resume file of its own, read back whole."""
    folder = shared_folder(v.spark, "resumes")
    key = F.concat("thread_id", F.lit("-"), "turn").alias("message")
    files = v.messages.select(key, F.col("text").alias("value"))
    resumes.write_texts(files, folder, "message")
    people = resumes.load_candidates(v.spark, folder, r"message=([^/]+)/")
    return people.select(
        "candidate_id",
        F.regexp_replace("resume_text", r"\n$", "").alias("resume_text"),
        "experience_years",
        F.size("must_have_skills").alias("skills"),
        F.size("preferred_locations").alias("locations"),
        "open_to_relocation",
        "requires_visa_sponsorship",
    )


@query
def artifact_files(v: Views) -> DataFrame:
    files = review.artifact_files(
        folds.merge_artifacts(v.artifact_deltas), folds.latest_status(v.status_events)
    )
    folder = shared_folder(v.spark, "artifacts")
    tables.write_artifacts(files, folder)
    return v.spark.read.parquet(folder).select(
        "candidate_id", "job_id", "file_name", "content"
    )


@query
def constraint_audit(v: Views) -> DataFrame:
    id_status = v.arrivals.select("job_id", F.lit(False).alias("is_scraped"))
    return ingest.constraint_audit(id_status, v.arrivals, v.metadata, v.vectors)


# ---- compatibility rules ------------------------------------------------------


def _jobs_with_facts(v: Views) -> DataFrame:
    return compat.with_metadata(v.postings, v.metadata)


def _single_rule(rule: str) -> Callable[[Views], DataFrame]:
    @named(f"filter_{rule}")
    def build(v: Views) -> DataFrame:
        keep = compatibility(literal_preferences(**ONE_CANDIDATE))[rule]
        return _jobs_with_facts(v).where(keep).select("job_id", "title")

    return build


for _rule in ("experience", "degree", "language", "skills", "location", "visa"):
    _single_rule(_rule)


def _pairs_with_facts(v: Views) -> DataFrame:
    pairs = v.pairs.select("candidate_id", "job_id")
    return compat.pairs_with_facts(pairs, v.people, v.postings, v.metadata)


@query
def compatible_jobs(v: Views) -> DataFrame:
    return compat.compatible_jobs(_pairs_with_facts(v)).select("candidate_id", "job_id")


@query
def filter_funnel(v: Views) -> DataFrame:
    return compat.filter_funnel(_pairs_with_facts(v))


# ---- similarity and ranking ---------------------------------------------------


@query
def similarity_pairs(v: Views) -> DataFrame:
    return similarity.pair_scores(v.pairs, v.candidates, v.vectors)


@query
def topk_similar(v: Views) -> DataFrame:
    return similarity.topk_similar(v.candidates, v.vectors, 10)


@query
def hydrate_after_topk(v: Views) -> DataFrame:
    found = similarity.topk_similar(v.candidates, v.vectors, search_width(10))
    return keyed.hydrate(found.select("candidate_id", "job_id", "score"), v.postings).select(
        "candidate_id", "job_id", "score", "title", "company"
    )


@named("match_resumes")
def best_postings(v: Views) -> DataFrame:
    m = match_resumes(v.candidates, v.vectors, v.postings, v.metadata, top_k=10)
    exp = F.col("metadata.experience_requirement")
    rel = F.col("metadata.relocation_requirement")
    return m.select(
        "candidate_id",
        "rank",
        "job_id",
        "title",
        "company",
        "location",
        "application_url",
        "description",
        "similarity_score",
        "passed_filters",
        exp["min_years_experience"].alias("min_experience_years"),
        rel["work_mode"].alias("work_mode"),
    )


@query
def first_three(v: Views) -> DataFrame:
    lines = F.split("description", "\n")
    return v.texts.select(
        "job_id", F.array_join(first_non_empty(lines), " | ").alias("first_lines")
    )


# ---- pending sets and state -----------------------------------------------------


@query
def pending_scrape(v: Views) -> DataFrame:
    ids = v.table("part").select(F.col("p_partkey").cast("string").alias("job_id"))
    return keyed.pending(ids, v.texts)


@query
def pending_extract(v: Views) -> DataFrame:
    return keyed.pending(v.texts.select("job_id", "description"), v.metadata)


@query
def pending_embed(v: Views) -> DataFrame:
    return keyed.pending(v.texts.select("job_id", "description"), v.vectors)


@query
def pending_by_sketch(v: Views) -> DataFrame:
    """Pending texts, known keys asked of the key sketches of a bucket table in two batches."""
    stored = BucketTable(v.spark, shared_folder(v.spark, "vectors"), schemas.VECTORS)
    odd = F.pmod(F.xxhash64("job_id"), F.lit(2)) == 1
    stored.append(v.vectors.where(odd), 0)
    stored.append(v.vectors.where(~odd), 1)
    return stored.missing(v.texts.select("job_id", "description"))


@query
def processing_state(v: Views) -> DataFrame:
    ids = v.table("part").select(F.col("p_partkey").cast("string").alias("job_id"))
    return keyed.processing_state(ids, v.texts, v.metadata, v.vectors)


# ---- decisions, documents, review -----------------------------------------------


@query
def approval_queue(v: Views) -> DataFrame:
    return review.approval_queue(folds.merge_artifacts(v.artifact_deltas), v.matches)


@query
def review_outcome(v: Views) -> DataFrame:
    return review.review_outcome(folds.merge_artifacts(v.artifact_deltas), v.answers)


@query
def review_counts(v: Views) -> DataFrame:
    return review.review_counts(review_outcome(v))


@query
def valid_decisions(v: Views) -> DataFrame:
    return review.check_decisions(v.decisions, v.matches).valid


@query
def decision_events(v: Views) -> DataFrame:
    return review.decision_events(valid_decisions(v))


@query
def any_pursued(v: Views) -> DataFrame:
    return folds.any_pursued(v.people, folded_decisions(v))


def folded_decisions(v: Views) -> DataFrame:
    return folds.last_write(valid_decisions(v), ["pursue", "reason"])


@query
def latest_status(v: Views) -> DataFrame:
    return folds.latest_status(v.status_events)


@query
def merge_artifacts(v: Views) -> DataFrame:
    return folds.merge_artifacts(v.artifact_deltas)


@query
def thread_summary(v: Views) -> DataFrame:
    return folds.thread_summary(v.messages)


@query
def review_note(v: Views) -> DataFrame:
    graded = v.table("labels").join(v.table("documents").select("doc_id", "n_chars"), "doc_id")
    issues = F.filter(
        F.array(
            F.when(F.col("toxic") == 1, "tone is off"),
            F.when(F.col("n_chars") % 2 == 0, "claims a skill the resume lacks"),
        ),
        lambda issue: issue.isNotNull(),
    )
    return graded.select(
        F.col("doc_id").cast("string").alias("job_id"),
        review.review_note(F.col("quality") == 1, issues).alias("note"),
    )


# ---- reports ------------------------------------------------------------------


def _match_profiles(v: Views) -> DataFrame:
    return v.matches.join(v.people, "candidate_id")


@query
def fit_report(v: Views) -> DataFrame:
    return reports.asked_fit_report(v.pairs, _match_profiles(v))


@query
def shortlist_text(v: Views) -> DataFrame:
    return reports.shortlist_text(v.people, v.matches)


@query
def handoff_text(v: Views) -> DataFrame:
    return reports.handoff_text(v.people, folded_decisions(v), v.matches)


@query
def posting_text(v: Views) -> DataFrame:
    return reports.posting_text(v.pairs, v.matches)


# ---- scalar functions -------------------------------------------------------------


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


@named("clean_text")
def clean_text_query(v: Views) -> DataFrame:
    return v.texts.select("job_id", clean_text(F.col("description")).alias("cleaned"))


@query
def posted_local_time(v: Views) -> DataFrame:
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    ms = F.timestamp_diff("MILLISECOND", epoch, F.col("ts"))
    return v.table("events").select("event_id", stamp(local_time(ms)).alias("posted_at"))


@query
def country_from_location(v: Views) -> DataFrame:
    names = payloads.gazetteer_names(v.table("region").select(F.col("r_name").alias("name")))
    place = F.concat("location", F.lit(" / "), F.col("country"))
    return v.postings.select("job_id", names_in_text(place, names).alias("countries"))


@query
def names_of_any_gazetteer(v: Views) -> DataFrame:
    """The same with the gazetteer as a table: nations, regions and every part name."""
    names = (
        v.table("region").select(F.col("r_name").alias("name"))
        .unionByName(v.table("nation").select(F.col("n_name").alias("name")))
        .unionByName(v.table("part").select(F.col("p_name").alias("name")))
    )
    place = F.concat("country", F.lit(", "), "location", F.lit("; "), "title", F.lit(" / "), "country")
    return with_names(v.postings.select("job_id", place.alias("place")), "place", names, "found").select("job_id", "found")


@named("strip_fences")
def strip_fences_query(v: Views) -> DataFrame:
    return v.replies.select("job_id", strip_fences(F.col("reply")).alias("bare"))


@query
def build_prompts(v: Views) -> DataFrame:
    return v.texts.select("job_id", build_prompt(F.col("description")).alias("prompt"))


@query
def coerce_bool(v: Views) -> DataFrame:
    return v.decisions.select("seq", as_bool(F.col("pursue")).alias("pursue"))


@query
def parse_preferences(v: Views) -> DataFrame:
    who = v.table("customer")
    skills = F.concat(
        F.lit(" "), "c_mktsegment", F.lit(" , ,"), "c_name", F.lit(",\t")
    )
    move = (
        F.when(F.col("c_nationkey") % 3 == 0, " Yes ")
        .when(F.col("c_nationkey") % 3 == 1, "nope")
        .otherwise("")
    )
    return who.select(
        F.col("c_custkey").alias("candidate_id"),
        F.array_join(csv_list(skills), "|").alias("must_have_skills"),
        F.size(csv_list(skills)).alias("skills"),
        is_approval(move).alias("open_to_relocation"),
    )


@query
def normalize_vectors(v: Views) -> DataFrame:
    """Doubled vectors brought back to length one, one row per dimension."""
    doubled = F.transform("embedding", lambda x: x * F.lit(2).cast("float"))
    unit = v.vectors.select("job_id", l2_normalize(doubled).alias("unit"))
    return unit.select("job_id", F.posexplode("unit").alias("dimension", "x")).select(
        "job_id", "dimension", F.round(F.col("x").cast("double"), 5).alias("x")
    )


# ---- requirement metadata ------------------------------------------------------------


def _rule_metadata(v: Views) -> DataFrame:
    return enrich.extract_requirements(v.ads)


@named("only_english")
def only_english_query(v: Views) -> DataFrame:
    languages = F.col("metadata.language_requirements")
    return _rule_metadata(v).select(
        "job_id",
        only_english(languages).alias("requires_only_english"),
        language_evidence(languages).alias("language_requirement_text"),
    )


@query
def flatten_metadata(v: Views) -> DataFrame:
    valid = enrich.validate_replies(v.replies).where("metadata IS NOT NULL")
    return enrich.flatten_metadata(valid)


@query
def rebuild_metadata(v: Views) -> DataFrame:
    m = F.col("metadata")
    exp, edu, rel = (
        m["experience_requirement"],
        m["higher_education_requirement"],
        m["relocation_requirement"],
    )
    return enrich.rebuild_metadata(v.metadata).select(
        "job_id",
        m.isNotNull().alias("has_metadata"),
        exp.isNotNull().alias("has_experience"),
        exp["min_years_experience"].alias("min_years"),
        exp["experience_requirement_evidence"].alias("experience_evidence"),
        edu.isNotNull().alias("has_education"),
        edu["is_masters_or_phd_required"].alias("degree"),
        edu["education_requirement_evidence"].alias("education_evidence"),
        rel.isNotNull().alias("has_relocation"),
        rel["visa_sponsorship_available"].alias("visa"),
        rel["relocation_assistance_provided"].alias("relocation"),
        rel["work_mode"].alias("work_mode"),
        rel["relocation_evidence"].alias("relocation_evidence"),
    )


@query
def validate_extractions(v: Views) -> DataFrame:
    checked = enrich.validate_replies(v.replies)
    return checked.select(
        "job_id",
        (F.size("errors") == 0).alias("ok"),
        F.array_join("errors", "; ").alias("errors"),
        F.size("metadata.language_requirements").alias("languages"),
        F.col("metadata.experience_requirement.min_years_experience").alias("min_years"),
        F.col("metadata.higher_education_requirement.is_masters_or_phd_required").alias(
            "degree"
        ),
        F.col("metadata.relocation_requirement.visa_sponsorship_available").alias("visa"),
        F.col("metadata.relocation_requirement.relocation_assistance_provided").alias(
            "relocation"
        ),
        F.col("metadata.relocation_requirement.work_mode").alias("work_mode"),
    )


@query
def extraction_outcomes(v: Views) -> DataFrame:
    return folds.outcome_counts(enrich.attempt_outcomes(enrich.validate_replies(v.replies)))


@query
def enrich_gaps(v: Views) -> DataFrame:
    """Matches without stored metadata, filled from the posting's sentences."""
    texts = v.ads.select("job_id", F.col("description").alias("ad"))
    matches = (
        v.matches.join(texts, "job_id").drop("description").withColumnRenamed("ad", "description")
    )
    return enrich.enrich_gaps(matches).select(
        "candidate_id",
        "job_id",
        "metadata_from",
        F.col("metadata.experience_requirement.min_years_experience").alias("min_years"),
        F.col("metadata.relocation_requirement.work_mode").alias("work_mode"),
    )


@query
def extract_batch(v: Views) -> DataFrame:
    """Stored rows, then a run over what is pending, then an idle run."""
    table = shared_folder(v.spark, "metadata")
    tables.write_batch(v.metadata, table, 0)
    for batch_id in (1, 2):
        stored = run_extract_batch(v.spark, v.ads, table, batch_id)
    return stored.select(*schemas.METADATA_COLUMNS)


@query
def extract_batch_model(v: Views) -> DataFrame:
    """Two batches of a model that errs: every entry of the ledger, with what was stored in the end."""
    folder = shared_folder(v.spark, "model")
    stored = BucketTable(v.spark, f"{folder}/metadata", schemas.METADATA)
    ledger = BucketTable(v.spark, f"{folder}/ledger", rounds.LEDGER)
    stored.append(v.metadata, 0)
    for batch_id in (1, 2):
        done = rounds.run_model_batch(v.texts, stored, ledger, batch_id, stubs.erring_model, template=stubs.PROMPT)
    facts = done.metadata.select("job_id", "min_experience_years", "experience_requirement_text", "work_mode", "relocation_evidence")
    return done.ledger.join(facts, "job_id", "left")


@query
def extraction_ledger(v: Views) -> DataFrame:
    """Outcomes that extraction by rules leaves behind, an idle batch included."""
    folder = shared_folder(v.spark, "ledger")
    tables.write_batch(v.metadata, f"{folder}/metadata", 0)
    for batch_id in (1, 2):
        run_extract_batch(v.spark, v.ads, f"{folder}/metadata", batch_id, outcomes=f"{folder}/outcomes")
    return tables.read_table(v.spark, f"{folder}/outcomes", "job_id STRING, outcome STRING, reason STRING")


@query
def extract_experience(v: Views) -> DataFrame:
    e = F.col("metadata.experience_requirement")
    return _rule_metadata(v).select(
        "job_id",
        e["min_years_experience"].alias("min_years"),
        e["experience_requirement_evidence"].alias("evidence"),
    )


@query
def extract_degree(v: Views) -> DataFrame:
    e = F.col("metadata.higher_education_requirement")
    return _rule_metadata(v).select(
        "job_id",
        e["is_masters_or_phd_required"].alias("degree"),
        e["education_requirement_evidence"].alias("evidence"),
    )


@query
def extract_languages(v: Views) -> DataFrame:
    listed = F.posexplode("metadata.language_requirements").alias("position", "item")
    return _rule_metadata(v).select("job_id", listed).select("job_id", "position", "item.*")


def _benefit(v: Views, rule: Callable[[Column], Column], name: str) -> DataFrame:
    cut = enrich.cut_sentences(v.ads)
    found = computed_once(cut, "found", rule(F.col("parts")))
    return found.select(
        "job_id",
        F.col("found.value").alias(name),
        F.col("found.sentence").alias("evidence"),
    )


@query
def extract_visa(v: Views) -> DataFrame:
    return _benefit(v, rules.visa, "visa")


@query
def extract_relocation(v: Views) -> DataFrame:
    return _benefit(v, rules.relocation_support, "relocation")


@query
def extract_work_mode(v: Views) -> DataFrame:
    found = _benefit(v, rules.work_mode, "work_mode")
    return found.withColumn("work_mode", F.coalesce("work_mode", F.lit("unknown")))


@query
def evidence_grounding(v: Views) -> DataFrame:
    """Evidence of the rules (verbatim) and of stored rows (not)."""
    nested = (
        _rule_metadata(v)
        .select("job_id", "metadata")
        .unionByName(enrich.rebuild_metadata(v.metadata))
    )
    return enrich.evidence_grounding(nested, v.ads)


@query
def evidence_spans(v: Views) -> DataFrame:
    """Where the evidence of rules stands, in texts whose lines were put together."""
    found = _rule_metadata(v)
    flowed = v.ads.select("job_id", F.regexp_replace("description", r"\s+", " \n ").alias("description"))
    return enrich.evidence_spans(found, flowed)


@query
def extraction_accuracy(v: Views) -> DataFrame:
    flat = enrich.flatten_metadata(_rule_metadata(v))
    truth = v.ads.select("job_id", "true_years", "true_english", "true_degree")

    def entry(field: str, expected: str, actual: str) -> Column:
        return F.struct(
            F.lit(field).alias("field"),
            F.col(expected).cast("string").alias("expected"),
            F.col(actual).cast("string").alias("actual"),
        )

    labelled = flat.join(truth, "job_id").select(
        "job_id",
        F.inline(
            F.array(
                entry("min_experience_years", "true_years", "min_experience_years"),
                entry("only_english_required", "true_english", "requires_only_english"),
                entry("higher_education_req", "true_degree", "requires_advanced_degree"),
            )
        ),
    )
    return folds.extraction_accuracy(labelled)


# ---- injected functions ------------------------------------------------------------------


@query
def embed_documents(v: Views) -> DataFrame:
    vectors = inference.embed_postings(v.texts, stubs.encoder)
    return vectors.select(
        "job_id", F.posexplode("embedding").alias("dimension", "x")
    ).select("job_id", "dimension", F.round(F.col("x").cast("double"), 5).alias("x"))


@query
def extract_with_retry(v: Views) -> DataFrame:
    prompts = v.texts.select(
        "job_id", build_prompt(F.col("description"), stubs.PROMPT).alias("prompt")
    )
    return inference.extract_with_retry(prompts, stubs.shy_model, stubs.must_be_object)


@query
def reviewed_drafts(v: Views) -> DataFrame:
    jobs = v.matches.withColumn("resume_text", F.lit("resume"))
    drafts = inference.reviewed_drafts(jobs, "cover letter", stubs.drafter, stubs.judge)
    return drafts.withColumn("issues", F.array_join("issues", "; "))


# ---- incremental ----------------------------------------------------------------------------


def _file_stream(v: Views, name: str) -> DataFrame:
    schema = v.table(name).schema
    return v.spark.readStream.schema(schema).parquet(f"{v.sf_dir}/{name}.parquet*")


@named("incremental_ingest")
def incremental_ingest_query(v: Views) -> DataFrame:
    """Two runs over the same landed files; the second adds nothing."""
    folder = shared_folder(v.spark, "ingest")
    stream = _file_stream(v, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"),
        F.col("source").alias("title"),
        F.when(F.col("lang") != "fr", F.col("lang")).alias("company"),
        F.col("text").alias("description"),
    )
    schema = "job_id STRING, title STRING, company STRING, description STRING"
    for _ in range(2):
        incremental_ingest(
            stream,
            f"{folder}/postings",
            f"{folder}/rejects",
            f"{folder}/progress",
            schema,
            [F.col("title")],
        )
    stored = posting_table(v.spark, f"{folder}/postings", schema)
    return stored.read()


@named("incremental_status")
def incremental_status_query(v: Views) -> DataFrame:
    folder = shared_folder(v.spark, "status")
    streaming = Views(v.spark, v.sf_dir)
    streaming.table = lambda name: _file_stream(v, name)
    streaming.n_documents = v.n_documents  # a stream cannot be counted
    for _ in range(2):
        incremental_status(
            streaming.status_events, f"{folder}/status", f"{folder}/progress"
        )
    return current_status(v.spark, f"{folder}/status")



@named("channel_handoffs")
def channel_handoffs_query(v: Views) -> DataFrame:
    """Every fourth turn hands off; the second run restarts from the checkpoint and adds nothing."""
    folder = shared_folder(v.spark, "channel")
    said = F.struct("role", "text")
    mark = F.struct(F.lit(HANDOFF).alias("role"), F.lit(None).cast("string").alias("text"))
    turns = (
        _file_stream(v, "conversations")
        .withColumn("said", F.explode(F.when(F.col("turn") % 4 == 3, F.array(said, mark)).otherwise(F.array(said))))
        .select(F.col("conv_id").alias("thread_id"), "turn", "said.role", "said.text")
    )
    for _ in range(2):
        incremental_handoffs(turns, f"{folder}/closed", f"{folder}/progress")
    return handoffs(v.spark, f"{folder}/closed")
