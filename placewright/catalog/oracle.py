"""The registered queries once more, as SQL over the raw test tables.

``VIEWS`` states the derived tables of ``views.py`` in SQL; each query names
the ones it needs. The SQL is written from the meaning of an operator, not
from the Spark plan, so that an error has to be made twice to pass.
"""

from __future__ import annotations

from placewright import wording as w
from placewright.catalog import views as facts
from placewright.functions import rules
from placewright.functions.prompts import DEFAULT_TEMPLATE, TEXT_MARK, fill, output_layout
from placewright.functions.text import BLANK
from placewright.functions.validation import (
    EDUCATION,
    EXPERIENCE,
    FALSE_TEXTS,
    FIELDS,
    INTEGER_TEXT,
    LANGUAGES,
    RELOCATION,
    TRUE_TEXTS,
)

ORACLE_SQL: dict[str, str] = {}


def text(value: object) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    escaped = str(value).replace("'", "''")
    if "\n" in escaped or "\t" in escaped:
        parts = escaped.replace("\t", "\n\t\n").split("\n\t\n")
        joined = " || chr(9) || ".join(
            " || chr(10) || ".join(f"'{line}'" for line in part.split("\n"))
            for part in parts
        )
        return f"({joined})"
    return f"'{escaped}'"


def case(selector: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values))
    return f"CASE {selector} {arms} END"


def one_of(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


def oracle(name: str, sql: str, *needs: str) -> None:
    """Register a check; ``needs`` are put in front as CTEs, in order."""
    ordered: list[str] = []

    def visit(wanted: str) -> None:
        for other in VIEWS[wanted][0]:
            visit(other)
        if wanted not in ordered:
            ordered.append(wanted)

    for need in needs:
        visit(need)
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1].strip()}\n)" for n in ordered)
    ORACLE_SQL[name] = (f"WITH {ctes}\n" if ctes else "") + sql.strip()


def profile(key: str) -> str:
    return f"""
  CASE WHEN {key} % 4 <> 0 THEN CAST({key} % 4 + 2 AS INTEGER) END AS experience_years,
  CASE WHEN {key} % 2 = 1 THEN ['The', 'en'] ELSE CAST([] AS VARCHAR[]) END AS must_have_skills,
  CASE {key} % 4 WHEN 1 THEN ['Europe'] WHEN 2 THEN ['  ']
    WHEN 3 THEN ['NATION_3', 'asia'] ELSE CAST([] AS VARCHAR[]) END AS preferred_locations,
  {key} % 5 = 0 AS open_to_relocation,
  {key} % 2 = 0 AS requires_visa_sponsorship"""


# ---- views ------------------------------------------------------------------

view(
    "postings",
    f"""
SELECT CAST(doc_id AS VARCHAR) AS job_id, p_type || ' ' || p_name AS title,
  p_brand AS company, text AS description, n_name || ', ' || r_name AS location,
  r_name AS country,
  'https://' || source || '.example/' || CAST(doc_id AS VARCHAR) AS application_url,
  {facts.FIRST_LISTING_MS} + n_chars * 60000 AS posted_ms, n_chars, lang
FROM documents LEFT JOIN part ON p_partkey = doc_id
LEFT JOIN nation ON n_nationkey = doc_id % 25
LEFT JOIN region ON r_regionkey = n_regionkey""",
)
view(
    "texts",
    """
SELECT CAST(doc_id AS VARCHAR) AS job_id, text AS description, n_chars, lang
FROM documents""",
)
view(
    "metadata",
    """
SELECT CAST(d.doc_id AS VARCHAR) AS job_id,
  CASE WHEN n_chars % 5 <> 0 THEN CAST(n_chars % 9 AS INTEGER) END AS min_experience_years,
  CASE WHEN n_chars % 11 = 0 THEN '' WHEN n_chars % 13 <> 0
    THEN 'ev exp ' || CAST(d.doc_id AS VARCHAR) END AS experience_requirement_text,
  CASE lang WHEN 'en' THEN true WHEN 'de' THEN false END AS requires_only_english,
  CASE WHEN lang IN ('en', 'de') THEN 'ev lang ' || lang END AS language_requirement_text,
  CASE WHEN toxic = 0 THEN quality = 0 END AS requires_advanced_degree,
  CASE WHEN n_chars % 7 <> 0 THEN 'ev edu ' || CAST(d.doc_id AS VARCHAR) END
    AS education_requirement_text,
  CASE n_chars % 3 WHEN 0 THEN false WHEN 1 THEN true END AS visa_sponsorship_available,
  CASE WHEN n_chars % 2 = 1 THEN true END AS relocation_assistance_provided,
  CASE n_chars % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite'
    ELSE 'unknown' END AS work_mode,
  CASE WHEN n_chars % 6 = 0 THEN '' ELSE 'ev move ' || CAST(d.doc_id AS VARCHAR) END
    AS relocation_evidence
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
view("vectors", "SELECT CAST(vec_id AS VARCHAR) AS job_id, embedding FROM embeddings")
view(
    "candidates",
    "SELECT vec_id AS candidate_id, embedding AS resume_embedding," + profile("vec_id")
    + "\nFROM embeddings",
)
view(
    "ev",
    """
SELECT user_id AS candidate_id,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 5 THEN json_extract_string(props, '$.k')
    ELSE CAST((user_id * 7919 + CAST(json_extract_string(props, '$.k') AS BIGINT) * 101)
      % (SELECT count(*) FROM documents) AS VARCHAR) END AS job_id,
  event_id AS seq, event_type, value, props
FROM events""",
)
view(
    "people",
    "SELECT user_id AS candidate_id," + profile("user_id")
    + "\nFROM (SELECT DISTINCT user_id FROM events)",
)
view(
    "pairs",
    """
SELECT candidate_id, job_id, max(value) / 1000 AS similarity_score
FROM ev GROUP BY candidate_id, job_id""",
    "ev",
)
view(
    "rebuilt",
    """
SELECT job_id,
  coalesce(experience_requirement_text, '') <> '' AS has_experience,
  requires_advanced_degree IS NOT NULL OR coalesce(education_requirement_text, '') <> ''
    AS has_education,
  coalesce(relocation_evidence, '') <> '' AS has_relocation,
  CASE WHEN coalesce(experience_requirement_text, '') <> '' THEN min_experience_years END
    AS min_years,
  CASE WHEN experience_requirement_text <> '' THEN experience_requirement_text END
    AS experience_evidence,
  requires_advanced_degree AS degree,
  education_requirement_text AS education_evidence,
  CASE WHEN relocation_evidence <> '' THEN visa_sponsorship_available END AS visa,
  CASE WHEN relocation_evidence <> '' THEN relocation_assistance_provided END AS relocation,
  CASE WHEN relocation_evidence <> '' THEN coalesce(nullif(work_mode, ''), 'unknown') END
    AS work_mode,
  CASE WHEN relocation_evidence <> '' THEN relocation_evidence END AS relocation_evidence
FROM metadata""",
    "metadata",
)
view(
    "matches",
    f"""
SELECT t.candidate_id, t.job_id, t.similarity_score, p.title, p.company, p.location,
  p.country, p.description, r.* EXCLUDE (job_id),
  coalesce(r.has_experience OR r.has_education OR r.has_relocation, false) AS has_metadata
FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id
    ORDER BY similarity_score DESC, job_id) AS place
  FROM (SELECT candidate_id, job_id, max(value) / 1000 AS similarity_score
    FROM ev WHERE event_type = 'view' GROUP BY candidate_id, job_id)) t
JOIN postings p ON p.job_id = t.job_id
LEFT JOIN rebuilt r ON r.job_id = t.job_id
WHERE place <= {facts.TOP_K}""",
    "ev",
    "postings",
    "rebuilt",
)
view(
    "decisions",
    """
SELECT candidate_id, job_id, seq,
  CASE event_type WHEN 'view' THEN 'True' WHEN 'click' THEN ' yes '
    WHEN 'purchase' THEN '1' WHEN 'error' THEN 'false' ELSE 'no' END AS pursue,
  event_type || ' ' || CAST(seq AS VARCHAR) AS reason
FROM ev""",
    "ev",
)
view(
    "valid",
    """
SELECT d.candidate_id, d.job_id, d.seq, d.reason,
  lower(trim(d.pursue)) IN ('true', '1', 'yes', 'y') AS pursue
FROM decisions d
WHERE EXISTS (SELECT 1 FROM matches m
  WHERE m.candidate_id = d.candidate_id AND m.job_id = d.job_id)""",
    "decisions",
    "matches",
)
view(
    "folded",
    """
SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id, job_id ORDER BY seq DESC) AS place
  FROM valid)
WHERE place = 1""",
    "valid",
)
view(
    "status",
    """
SELECT candidate_id, job_id, seq,
  CASE event_type WHEN 'view' THEN 'shortlisted' WHEN 'click' THEN 'tailored'
    WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'skipped' ELSE 'expired' END AS status,
  CASE WHEN seq % 2 = 1 THEN props END AS notes
FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, job_id ORDER BY seq DESC)
  AS place FROM ev)
WHERE place = 1""",
    "ev",
)
view(
    "artifacts",
    """
SELECT candidate_id, job_id,
  'R' || CAST(max(seq) FILTER (WHERE event_type = 'view') AS VARCHAR) AS tailored_resume,
  arg_max(CASE event_type WHEN 'click' THEN 'C' || CAST(seq AS VARCHAR) ELSE '' END, seq)
    FILTER (WHERE event_type IN ('click', 'signup')) AS cover_letter
FROM ev GROUP BY candidate_id, job_id""",
    "ev",
)
view(
    "answers",
    """
SELECT candidate_id, job_id, arg_max(CASE event_type WHEN 'purchase' THEN ' APPROVE '
  WHEN 'click' THEN 'y' ELSE 'skip' END, seq) AS answer
FROM ev WHERE event_type IN ('purchase', 'click', 'error')
GROUP BY candidate_id, job_id""",
    "ev",
)
view(
    "arrivals",
    """
SELECT CAST(l_partkey AS VARCHAR) AS job_id,
  'lot ' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS title,
  CASE WHEN l_returnflag <> 'R' THEN 'supplier ' || CAST(l_suppkey AS VARCHAR) END AS company,
  l_linestatus || ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS description,
  l_shipdate AS landed_at
FROM lineitem""",
)
view(
    "ads",
    f"""
SELECT job_id,
  concat_ws(chr(10), description,
    {case('n_chars % 6', facts.YEARS_TEXT)},
    {case('n_chars % 5', facts.DEGREE_TEXT)},
    {case('n_chars % 7', facts.LANGUAGE_TEXT)},
    {case('n_chars % 3', facts.VISA_TEXT)},
    {case('n_chars % 4', facts.MOVE_TEXT)},
    {case('(n_chars // 5) % 4', facts.MODE_TEXT)}) AS description,
  {case('n_chars % 6', facts.YEARS_TRUTH)} AS true_years,
  {case('n_chars % 5', facts.DEGREE_TRUTH)} AS true_degree,
  {case('n_chars % 7', facts.ENGLISH_TRUTH)} AS true_english
FROM texts""",
    "texts",
)
def parted(column: str) -> str:
    for pattern, between in rules.CLAUSE_ENDS:
        kept = "'\\1' || chr(10) || '\\2'" if "$" in between else "chr(10)"
        column = f"regexp_replace({column}, {text(pattern)}, {kept}, 'g')"
    return column


view(
    "sentences",
    f"""
SELECT job_id, pos * 1000 + nth AS pos, trim(clause) AS s FROM (
  SELECT job_id, pos, unnest(clauses) AS clause, generate_subscripts(clauses, 1) AS nth FROM (
    SELECT job_id, pos, string_split({parted('piece')}, chr(10)) AS clauses FROM (
      SELECT job_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos
      FROM (SELECT job_id, regexp_extract_all(description, {text(rules.SENTENCE)}) AS pieces
        FROM ads))
    WHERE NOT regexp_matches(piece, {text(rules.QUESTION)})))
WHERE trim(clause) <> ''""",
    "ads",
)


def says(pattern: str, column: str = "s") -> str:
    return f"regexp_matches({column}, {text(pattern)})"


view(
    "stated_years",
    f"""
SELECT job_id, pos, s, min(y) AS years FROM (
  SELECT job_id, pos, s, coalesce(CAST(floor(try_cast(token AS DOUBLE)) AS INTEGER),
    list_position({list(rules.NUMBER_WORDS)}, lower(token))) AS y
  FROM (SELECT job_id, pos, s, unnest(regexp_extract_all(s, {text(rules.YEARS)}, 1)) AS token
    FROM sentences WHERE {says(rules.YEARS)} AND {says(rules.EXPERIENCE_CONTEXT)}
      AND NOT {says(rules.OWN_YEARS)}))
GROUP BY job_id, pos, s""",
    "sentences",
)
view(
    "years",
    """
SELECT job_id, arg_min(years, (years, pos)) AS min_years, arg_min(s, (years, pos)) AS evidence
FROM stated_years GROUP BY job_id""",
    "stated_years",
)


def decided(verdict: str, strong: str) -> str:
    """First sentence of the strong verdict, else the first with any."""
    return f"""
SELECT job_id, arg_min(v, (v <> {strong}, pos)) AS value,
  arg_min(s, (v <> {strong}, pos)) AS evidence
FROM (SELECT job_id, pos, s, {verdict} AS v FROM sentences)
WHERE v IS NOT NULL GROUP BY job_id"""


view(
    "degrees",
    decided(
        f"""CASE WHEN {says(rules.ADVANCED)} THEN
      CASE WHEN {says(rules.OPTIONAL)} OR {says(rules.NOT_NEEDED)} OR {says(rules.BACHELOR)}
        THEN false WHEN {says(rules.MANDATORY)} THEN true END
    WHEN {says(rules.BACHELOR)} THEN false END""",
        "true",
    ),
    "sentences",
)
for _name, _subject in (("visas", rules.SPONSORSHIP), ("moves", rules.RELOCATION)):
    view(
        _name,
        decided(
            f"""CASE WHEN NOT {says(_subject)} THEN NULL WHEN {says(rules.DENIED)} THEN false
      WHEN {says(rules.GRANTED)} THEN true END""",
            "false",
        ),
        "sentences",
    )
view(
    "modes",
    f"""
SELECT job_id, arg_min(v, pos) AS value, arg_min(s, pos) AS evidence FROM (
  SELECT job_id, pos, s, CASE WHEN {says(rules.HYBRID)} THEN 'hybrid'
    WHEN {says(rules.REMOTE)} AND NOT {says(rules.NOT_REMOTE)} THEN 'remote'
    WHEN {says(rules.ONSITE)} THEN 'onsite' END AS v
  FROM sentences)
WHERE v IS NOT NULL GROUP BY job_id""",
    "sentences",
)
view(
    "named",
    f"""
SELECT job_id, pos, nth, s, language, nullif(regexp_extract(s, {text(rules.LEVEL)}, 1), '')
    AS level,
  CASE WHEN {says(rules.NOT_NEEDED)} THEN 'not_required'
    WHEN {says(rules.OPTIONAL)} THEN 'good_to_have'
    WHEN {says(rules.MANDATORY)} OR {says('(?i)\\b(?:fluent|native)\\b')} THEN 'required'
    ELSE 'mentioned' END AS requirement
FROM (
  SELECT job_id, pos, s, language, min(i) AS nth FROM (
    SELECT job_id, pos, s, unnest(found) AS language, generate_subscripts(found, 1) AS i
    FROM (SELECT job_id, pos, s, list_transform(regexp_extract_all(s, {text(rules.LANGUAGE)}, 1),
        lambda x: upper(x[1]) || lower(x[2:])) AS found
      FROM sentences WHERE {says(rules.LANGUAGE)}))
  GROUP BY job_id, pos, s, language)""",
    "sentences",
)
view(
    "english",
    """
SELECT job_id, bool_and(lower(language) = 'english') AS requires_only_english,
  string_agg(s, ' | ' ORDER BY pos, nth) AS language_requirement_text
FROM named WHERE requirement = 'required' GROUP BY job_id""",
    "named",
)
view(
    "ruled",
    """
SELECT a.job_id, y.min_years AS min_experience_years,
  y.evidence AS experience_requirement_text,
  e.requires_only_english, e.language_requirement_text,
  d.value AS requires_advanced_degree, d.evidence AS education_requirement_text,
  v.value AS visa_sponsorship_available, r.value AS relocation_assistance_provided,
  CASE WHEN coalesce(v.evidence, r.evidence, m.evidence) IS NOT NULL
    THEN coalesce(m.value, 'unknown') END AS work_mode,
  coalesce(v.evidence, r.evidence, m.evidence) AS relocation_evidence
FROM ads a LEFT JOIN years y USING (job_id) LEFT JOIN english e USING (job_id)
LEFT JOIN degrees d USING (job_id) LEFT JOIN visas v USING (job_id)
LEFT JOIN moves r USING (job_id) LEFT JOIN modes m USING (job_id)""",
    "ads",
    "years",
    "english",
    "degrees",
    "visas",
    "moves",
    "modes",
)

# ---- sources and table state ---------------------------------------------------

oracle(
    "parse_search_pages",
    """
SELECT doc_id // 100 AS page_no, count(*) OVER (PARTITION BY doc_id // 100) AS total,
  CAST(doc_id AS VARCHAR) AS job_id
FROM documents""",
)
CLEAN = f"trim(regexp_replace(description, {text(BLANK + '+')}, ' ', 'g'))"


def stamp(micros: str) -> str:
    """Wall clock at +05:30 of epoch microseconds, to the millisecond."""
    return (
        f"strftime(make_timestamp({micros} + 19800000000), '%Y-%m-%d %H:%M:%S.%g')"
    )


oracle(
    "parse_posting_details",
    f"""
SELECT job_id, title,
  CASE WHEN n_chars % 4 <> 0 THEN company WHEN n_chars % 8 <> 0 THEN company || ' Inc' END
    AS company,
  {CLEAN} AS description, location, {stamp('posted_ms * 1000')} AS posted_at,
  CASE n_chars % 3 WHEN 0 THEN 'https://easy.example/' || job_id WHEN 1 THEN ''
    ELSE application_url END AS application_url,
  country
FROM postings WHERE n_chars % 17 <> 0 AND n_chars % 19 <> 0""",
    "postings",
)
oracle(
    "ingest_new_ids",
    """
SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS job_id, false AS is_scraped
FROM lineitem WHERE l_partkey NOT IN (SELECT doc_id FROM documents)""",
)
oracle(
    "ingest_postings",
    """
SELECT job_id, title, company, description FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id
    ORDER BY landed_at, title, company, description) AS place
  FROM arrivals WHERE company IS NOT NULL)
WHERE place = 1 AND job_id NOT IN (SELECT job_id FROM texts)""",
    "arrivals",
    "texts",
)
oracle(
    "exclude_titles",
    """
SELECT job_id, title FROM postings
WHERE coalesce(lower(title) NOT LIKE '%intern%' AND lower(title) NOT LIKE '%part%'
  AND lower(title) NOT LIKE '%ring%' AND lower(title) NOT LIKE '%bolt%', true)""",
    "postings",
)
oracle(
    "drop_closed",
    """
SELECT job_id, title FROM postings p WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT job_id, arg_max(event_type, seq) AS last FROM ev GROUP BY job_id) s
  WHERE s.job_id = p.job_id AND s.last = 'error')""",
    "postings",
    "ev",
)
oracle(
    "hydrate_hits",
    """
SELECT candidate_id, p.job_id, title, company, description, location, country,
  application_url
FROM pairs JOIN postings p ON p.job_id = pairs.job_id""",
    "pairs",
    "postings",
)
oracle(
    "metadata_lookup",
    """
SELECT * EXCLUDE (language_requirement_text) FROM metadata
WHERE job_id IN (SELECT job_id FROM pairs)""",
    "metadata",
    "pairs",
)

WORDS = f"""
SELECT job_id, ('0x' || md5(word)[1:4])::INTEGER % 64 AS dimension, count(*) AS n FROM (
  SELECT job_id, unnest(string_split_regex(description, {text(BLANK + '+')})) AS word
  FROM texts)
WHERE word <> '' GROUP BY ALL"""
view("words", WORDS, "texts")
view(
    "norms",
    "SELECT job_id, sqrt(sum(n * n)::DOUBLE) AS norm, max(n) AS top FROM words GROUP BY job_id",
    "words",
)
oracle(
    "append_vectors",
    """
SELECT job_id, len(embedding) AS dimensions,
  round(CAST(list_max(embedding) AS DOUBLE), 5) AS largest
FROM vectors
UNION ALL
SELECT t.job_id, 64, round(CAST(CAST(coalesce(top / norm, 0) AS FLOAT) AS DOUBLE), 5)
FROM texts t LEFT JOIN norms USING (job_id)
WHERE t.description <> '' AND t.job_id NOT IN (SELECT job_id FROM vectors)""",
    "vectors",
    "norms",
    "texts",
)
oracle(
    "load_candidates",
    """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS candidate_id,
  text AS resume_text, 3 AS experience_years,
  0 AS skills, 0 AS locations, false AS open_to_relocation,
  false AS requires_visa_sponsorship
FROM conversations""",
)
oracle(
    "artifact_files",
    """
SELECT candidate_id, job_id, file_name, content FROM (
  SELECT candidate_id, job_id, 'tailored_resume.md' AS file_name, tailored_resume AS content
  FROM artifacts
  UNION ALL
  SELECT candidate_id, job_id, 'cover_letter.md', cover_letter FROM artifacts) f
WHERE content <> '' AND NOT EXISTS (SELECT 1 FROM status s
  WHERE s.candidate_id = f.candidate_id AND s.job_id = f.job_id
    AND s.status IN ('skipped', 'expired'))""",
    "artifacts",
    "status",
)
oracle(
    "constraint_audit",
    """
SELECT 'id_status' AS table_name, 'job_id unique' AS rule,
  count(job_id) - count(DISTINCT job_id) AS violations FROM arrivals
UNION ALL SELECT 'id_status', 'is_scraped not null', 0
UNION ALL SELECT 'postings', 'job_id unique', count(job_id) - count(DISTINCT job_id)
FROM arrivals
UNION ALL SELECT 'postings', 'job_id not null', count(*) - count(job_id) FROM arrivals
UNION ALL SELECT 'postings', 'title not null', count(*) - count(title) FROM arrivals
UNION ALL SELECT 'postings', 'company not null', count(*) - count(company) FROM arrivals
UNION ALL SELECT 'postings', 'description not null', count(*) - count(description)
FROM arrivals
UNION ALL SELECT 'metadata', 'job_id unique', count(job_id) - count(DISTINCT job_id)
FROM metadata
UNION ALL SELECT 'metadata', 'job_id references postings',
  count(*) FILTER (WHERE job_id NOT IN (SELECT job_id FROM arrivals)) FROM metadata
UNION ALL SELECT 'vectors', 'job_id references postings',
  count(*) FILTER (WHERE job_id NOT IN (SELECT job_id FROM arrivals)) FROM vectors""",
    "arrivals",
    "metadata",
    "vectors",
)

# ---- compatibility ----------------------------------------------------------------

PLACE = """lower(concat_ws(' ', nullif(location, ''), nullif(country, '')))"""
ONE_RULE = {
    "experience": "coalesce(min_experience_years, 0) <= 4",
    "degree": "requires_advanced_degree IS DISTINCT FROM true",
    "language": "requires_only_english IS DISTINCT FROM false",
    "skills": "contains(lower(description), 'the') AND contains(lower(description), 'en')",
    "location": f"work_mode IS NOT DISTINCT FROM 'remote' OR contains({PLACE}, 'europe')",
    "visa": "visa_sponsorship_available IS DISTINCT FROM false",
}
for _rule, _condition in ONE_RULE.items():
    oracle(
        f"filter_{_rule}",
        f"""
SELECT p.job_id, title FROM postings p LEFT JOIN metadata m ON m.job_id = p.job_id
WHERE {_condition}""",
        "postings",
        "metadata",
    )
PERSON_RULES = {
    "experience": "experience_years IS NULL OR coalesce(min_experience_years, 0) "
    "<= experience_years",
    "degree": ONE_RULE["degree"],
    "language": ONE_RULE["language"],
    "skills": "NOT list_contains(list_transform(must_have_skills, "
    "lambda x: contains(lower(description), lower(x))), false)",
    "location": "len(preferred_locations) = 0 OR open_to_relocation OR "
    "work_mode IS NOT DISTINCT FROM 'remote' OR list_contains(list_transform("
    f"preferred_locations, lambda x: trim(x) <> '' AND contains({PLACE}, lower(x))), true)",
    "visa": "NOT requires_visa_sponsorship OR visa_sponsorship_available "
    "IS DISTINCT FROM false",
}
FLAGS = ",\n  ".join(f"({c}) AS ok_{r}" for r, c in PERSON_RULES.items())
ALL_OK = " AND ".join(f"ok_{r}" for r in PERSON_RULES)
view(
    "judged",
    f"""
SELECT candidate_id, p.job_id,
  {FLAGS}
FROM pairs JOIN postings p ON p.job_id = pairs.job_id
LEFT JOIN metadata m ON m.job_id = p.job_id
JOIN people USING (candidate_id)""",
    "pairs",
    "postings",
    "metadata",
    "people",
)
oracle("compatible_jobs", f"SELECT candidate_id, job_id FROM judged WHERE {ALL_OK}", "judged")
oracle(
    "filter_funnel",
    f"""
SELECT candidate_id, count(*) AS jobs_in, count(*) FILTER (WHERE {ALL_OK}) AS jobs_kept,
  count(*) FILTER (WHERE NOT ({ALL_OK})) AS jobs_dropped,
  {", ".join(f"count(*) FILTER (WHERE NOT ok_{r}) AS dropped_{r}" for r in PERSON_RULES)}
FROM judged GROUP BY candidate_id""",
    "judged",
)

# ---- similarity ----------------------------------------------------------------------

SCORE = (
    "round(list_inner_product(CAST(resume_embedding AS DOUBLE[]), "
    "CAST(embedding AS DOUBLE[])), 9)"
)
oracle(
    "similarity_pairs",
    f"""
SELECT candidate_id, job_id, {SCORE} AS score
FROM pairs JOIN candidates USING (candidate_id) JOIN vectors USING (job_id)""",
    "pairs",
    "candidates",
    "vectors",
)
view(
    "scored",
    f"""
SELECT candidate_id, job_id, {SCORE} AS score FROM candidates, vectors""",
    "candidates",
    "vectors",
)
view(
    "nearest",
    """
SELECT * FROM (
  SELECT candidate_id, job_id, score, row_number() OVER (PARTITION BY candidate_id
    ORDER BY score DESC, job_id) AS rank FROM scored)
WHERE rank <= 20""",
    "scored",
)
oracle("topk_similar", "SELECT * FROM nearest WHERE rank <= 10", "nearest")
oracle(
    "hydrate_after_topk",
    """
SELECT candidate_id, p.job_id, score, title, company
FROM nearest JOIN postings p ON p.job_id = nearest.job_id""",
    "nearest",
    "postings",
)
oracle(
    "match_resumes",
    f"""
SELECT * FROM (
  SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id
      ORDER BY score DESC, job_id) AS rank,
    job_id, title, company, location, application_url, description,
    score AS similarity_score, true AS passed_filters, min_years AS min_experience_years,
    work_mode
  FROM (
    SELECT n.candidate_id, n.score, p.*, r.min_years, r.work_mode FROM nearest n
    JOIN postings p ON p.job_id = n.job_id
    LEFT JOIN rebuilt r ON r.job_id = n.job_id
    JOIN (
      SELECT candidate_id, h.job_id,
        {FLAGS}
      FROM nearest h JOIN postings ON postings.job_id = h.job_id
      LEFT JOIN metadata m ON m.job_id = h.job_id
      JOIN candidates USING (candidate_id)) ok
    ON ok.candidate_id = n.candidate_id AND ok.job_id = n.job_id
    WHERE {ALL_OK}))
WHERE rank <= 10""",
    "nearest",
    "postings",
    "rebuilt",
    "metadata",
    "candidates",
)
oracle(
    "first_three",
    """
SELECT job_id, array_to_string(list_filter(string_split(description, chr(10)),
  lambda x: x <> '')[1:3], ' | ') AS first_lines
FROM texts""",
    "texts",
)

# ---- pending sets ------------------------------------------------------------------------

oracle(
    "pending_scrape",
    """
SELECT CAST(p_partkey AS VARCHAR) AS job_id FROM part
WHERE p_partkey NOT IN (SELECT doc_id FROM documents)""",
)
oracle(
    "pending_extract",
    """
SELECT job_id, description FROM texts WHERE job_id NOT IN (SELECT job_id FROM metadata)""",
    "texts",
    "metadata",
)
oracle(
    "pending_embed",
    """
SELECT job_id, description FROM texts WHERE job_id NOT IN (SELECT job_id FROM vectors)""",
    "texts",
    "vectors",
)
oracle(
    "pending_by_sketch",
    """
SELECT job_id, description FROM texts WHERE job_id NOT IN (SELECT job_id FROM vectors)""",
    "texts",
    "vectors",
)
oracle(
    "processing_state",
    """
SELECT CAST(p_partkey AS VARCHAR) AS job_id,
  p_partkey IN (SELECT doc_id FROM documents) AS is_scraped,
  CAST(p_partkey AS VARCHAR) IN (SELECT job_id FROM metadata) AS is_processed,
  p_partkey IN (SELECT vec_id FROM embeddings) AS is_embedded
FROM part""",
    "metadata",
)

# ---- decisions and review ----------------------------------------------------------------

oracle(
    "approval_queue",
    """
SELECT a.candidate_id, a.job_id, coalesce(title, '?') AS title,
  coalesce(company, '?') AS company, coalesce(tailored_resume, '') <> '' AS has_resume,
  coalesce(cover_letter, '') <> '' AS has_cover_letter
FROM artifacts a LEFT JOIN matches m ON m.candidate_id = a.candidate_id
  AND m.job_id = a.job_id""",
    "artifacts",
    "matches",
)
view(
    "outcome",
    f"""
SELECT a.candidate_id, a.job_id,
  coalesce(lower(trim(answer)) IN ('y', 'yes', 'apply', 'approve', 'approved'), false)
    AS approved
FROM artifacts a LEFT JOIN answers w ON w.candidate_id = a.candidate_id
  AND w.job_id = a.job_id""",
    "artifacts",
    "answers",
)
oracle(
    "review_outcome",
    f"""
SELECT candidate_id, job_id, CASE WHEN approved THEN 'applied' ELSE 'skipped' END AS status,
  CASE WHEN approved THEN {text(w.REVIEW_APPROVED)} ELSE {text(w.REVIEW_SKIPPED)} END AS notes
FROM outcome""",
    "outcome",
)
oracle(
    "review_counts",
    """
SELECT candidate_id, count(*) AS reviewed, count(*) FILTER (WHERE approved) AS approved,
  count(*) FILTER (WHERE NOT approved) AS skipped
FROM outcome GROUP BY candidate_id""",
    "outcome",
)
oracle("valid_decisions", "SELECT * FROM valid", "valid")
oracle(
    "decision_events",
    """
SELECT *, CASE WHEN NOT pursue THEN 'skipped' END AS status,
  CASE WHEN NOT pursue THEN 'screened out: ' || reason END AS notes
FROM valid""",
    "valid",
)
oracle(
    "any_pursued",
    """
SELECT candidate_id, pursued,
  CASE WHEN pursued THEN 'preparer' ELSE 'human_review' END AS next_step
FROM (SELECT p.candidate_id, coalesce(bool_or(pursue), false) AS pursued
  FROM people p LEFT JOIN folded f ON f.candidate_id = p.candidate_id
  GROUP BY p.candidate_id)""",
    "people",
    "folded",
)
oracle("latest_status", "SELECT candidate_id, job_id, status, notes FROM status", "status")
oracle("merge_artifacts", "SELECT * FROM artifacts", "artifacts")
oracle(
    "thread_summary",
    """
SELECT conv_id AS thread_id,
  arg_max(text, turn) FILTER (WHERE role = 'assistant' AND text <> '') AS summary
FROM conversations GROUP BY conv_id""",
)
oracle(
    "review_note",
    f"""
SELECT CAST(doc_id AS VARCHAR) AS job_id,
  CASE WHEN quality = 1 THEN {text(w.DRAFT_PASSED)}
    ELSE {text(w.DRAFT_ISSUES.replace('%s', ''))} || coalesce(nullif(concat_ws('; ',
      CASE WHEN toxic = 1 THEN 'tone is off' END,
      CASE WHEN n_chars % 2 = 0 THEN 'claims a skill the resume lacks' END), ''),
      {text(w.DRAFT_ISSUE_UNSPECIFIED)}) END AS note
FROM labels JOIN documents USING (doc_id)""",
)

# ---- reports ----------------------------------------------------------------------------------


def fmt(pattern: str, *args: str) -> str:
    """``format_string`` as a concatenation."""
    pieces = pattern.replace("%.2f", "%s").replace("%d", "%s").split("%s")
    out = []
    for index, piece in enumerate(pieces):
        if piece:
            out.append(text(piece))
        if index < len(args):
            out.append(f"CAST({args[index]} AS VARCHAR)")
    return "(" + " || ".join(out) + ")"


#: half-up on the decimal value, as the report formats it
TWO = "round(CAST(similarity_score AS DECIMAL(18, 9)), 2)::DECIMAL(18, 2)"
SKILLS_IN = "list_filter(must_have_skills, lambda x: contains(lower(description), lower(x)))"
SKILLS_OUT = (
    "list_filter(must_have_skills, lambda x: NOT contains(lower(description), lower(x)))"
)
FIT = f"""concat_ws(chr(10),
  {fmt(w.FIT_HEADER, 'title', 'company', 'job_id')},
  {fmt(w.FIT_SCORE, TWO)},
  CASE WHEN min_years IS NULL THEN {text(w.FIT_YEARS_NONE)}
    WHEN experience_years IS NULL THEN {fmt(w.FIT_YEARS_UNKNOWN, 'min_years')}
    WHEN experience_years >= min_years
      THEN {fmt(w.FIT_YEARS_MET, 'min_years', 'experience_years')}
    ELSE {fmt(w.FIT_YEARS_SHORT, 'min_years', 'experience_years',
              '(min_years - experience_years)')} END,
  CASE WHEN degree THEN {text(w.FIT_DEGREE_REQUIRED)}
    WHEN NOT degree THEN {text(w.FIT_DEGREE_NOT_REQUIRED)}
    ELSE {text(w.FIT_DEGREE_NOT_STATED)} END,
  CASE WHEN work_mode IS NULL THEN {text(w.FIT_MODE_NOT_STATED)}
    ELSE {fmt(w.FIT_MODE, 'work_mode')} END,
  CASE WHEN work_mode IS NOT NULL AND requires_visa_sponsorship THEN
    CASE WHEN visa THEN {text(w.FIT_VISA_YES)} WHEN NOT visa THEN {text(w.FIT_VISA_NO)}
      ELSE {text(w.FIT_VISA_UNKNOWN)} END END,
  CASE WHEN len({SKILLS_IN}) > 0 THEN {text(w.FIT_SKILLS_PRESENT.replace('%s', ''))}
    || array_to_string({SKILLS_IN}, ', ') END,
  CASE WHEN len({SKILLS_OUT}) > 0 THEN {text(w.FIT_SKILLS_MISSING.replace('%s', ''))}
    || array_to_string({SKILLS_OUT}, ', ') END,
  CASE WHEN len(preferred_locations) > 0 THEN
    {fmt(w.FIT_LOCATION, "coalesce(nullif(location, ''), 'unknown')",
         "array_to_string(preferred_locations, ', ')")} END)"""
oracle(
    "fit_report",
    f"""
SELECT p.candidate_id, p.job_id,
  coalesce(report, {fmt(w.NOT_SHORTLISTED, 'p.job_id')}) AS report
FROM pairs p LEFT JOIN (
  SELECT candidate_id, job_id, {FIT} AS report FROM matches JOIN people USING (candidate_id)) r
ON r.candidate_id = p.candidate_id AND r.job_id = p.job_id""",
    "pairs",
    "matches",
    "people",
)
oracle(
    "shortlist_text",
    f"""
SELECT p.candidate_id, coalesce({text(w.SHORTLIST_HEADER)} || chr(10) || lines,
  {text(w.SHORTLIST_EMPTY)}) AS text
FROM people p LEFT JOIN (
  SELECT candidate_id, string_agg(line, chr(10) ORDER BY n) AS lines FROM (
    SELECT candidate_id, n, concat_ws({text(w.DASH)},
      {fmt(w.SHORTLIST_ENTRY, 'n', 'job_id', 'title', 'company')},
      {fmt(w.SHORTLIST_SCORE, TWO)}, nullif(location, ''),
      {fmt(w.SHORTLIST_YEARS, 'min_years')}, work_mode) AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id
      ORDER BY similarity_score DESC, job_id) AS n FROM matches))
  GROUP BY candidate_id) s ON s.candidate_id = p.candidate_id""",
    "people",
    "matches",
)
oracle(
    "handoff_text",
    f"""
SELECT p.candidate_id, coalesce({text(w.HANDOFF_HEADER)} || chr(10) || lines,
  {text(w.HANDOFF_EMPTY)}) AS text
FROM people p LEFT JOIN (
  SELECT f.candidate_id, string_agg({fmt(w.HANDOFF_ENTRY, 'f.job_id',
      "(m.title || ' at ' || m.company)", 'f.reason')}, chr(10) ORDER BY f.job_id) AS lines
  FROM folded f JOIN matches m ON m.candidate_id = f.candidate_id AND m.job_id = f.job_id
  WHERE pursue GROUP BY f.candidate_id) h ON h.candidate_id = p.candidate_id""",
    "people",
    "folded",
    "matches",
)
oracle(
    "posting_text",
    f"""
SELECT p.candidate_id, p.job_id,
  CASE WHEN m.job_id IS NULL THEN {fmt(w.NOT_SHORTLISTED, 'p.job_id')}
    WHEN description = '' THEN {fmt(w.POSTING_NO_TEXT, 'p.job_id')}
    ELSE title || ' at ' || company || ' (' || location || '):' || chr(10) || chr(10)
      || description END AS posting_text
FROM pairs p LEFT JOIN matches m ON m.candidate_id = p.candidate_id AND m.job_id = p.job_id""",
    "pairs",
    "matches",
)

# ---- scalar functions ----------------------------------------------------------------------

oracle("clean_text", f"SELECT job_id, {CLEAN} AS cleaned FROM texts", "texts")
oracle(
    "posted_local_time",
    f"SELECT event_id, {stamp('(epoch_us(ts) // 1000) * 1000')} AS posted_at FROM events",
)
oracle(
    "names_of_any_gazetteer",
    """
SELECT job_id, CASE WHEN title IS NOT NULL AND country IS NOT NULL AND location IS NOT NULL
  THEN array_to_string(regexp_extract_all(country || ', ' || location || '; ' || title || ' / ' || country,
    (SELECT '\\b(' || string_agg(name, '|' ORDER BY length(name) DESC, name) || ')\\b' FROM (
      SELECT DISTINCT r_name AS name FROM region UNION SELECT n_name FROM nation UNION SELECT p_name FROM part)), 1), ' ') END AS found
FROM postings""",
    "postings",
)
oracle("country_from_location", "SELECT job_id, country || ' ' || country AS countries FROM postings", "postings")
oracle(
    "build_prompts",
    f"""
SELECT job_id, replace({text(fill(DEFAULT_TEMPLATE, output_layout()))}, {text(TEXT_MARK)},
  description) AS prompt
FROM texts""",
    "texts",
)
oracle(
    "coerce_bool",
    """
SELECT event_id AS seq, event_type IN ('view', 'click', 'purchase') AS pursue FROM events""",
)
oracle(
    "parse_preferences",
    """
SELECT c_custkey AS candidate_id, c_mktsegment || '|' || c_name AS must_have_skills,
  2 AS skills, c_nationkey % 3 = 0 AS open_to_relocation
FROM customer""",
)
oracle(
    "normalize_vectors",
    """
SELECT job_id, i - 1 AS dimension, round(CAST(CAST(x / norm AS FLOAT) AS DOUBLE), 5) AS x
FROM (SELECT job_id, CAST(unnest(embedding) AS DOUBLE) AS x,
    generate_subscripts(embedding, 1) AS i,
    sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
  FROM vectors)""",
    "vectors",
)
oracle(
    "embed_documents",
    """
SELECT t.job_id, dimension,
  round(CAST(CAST(coalesce(n / norm, 0) AS FLOAT) AS DOUBLE), 5) AS x
FROM (SELECT job_id, unnest(range(64)) AS dimension FROM texts WHERE description <> '') t
LEFT JOIN words USING (job_id, dimension) LEFT JOIN norms ON norms.job_id = t.job_id""",
    "texts",
    "words",
    "norms",
)

# ---- model replies ------------------------------------------------------------------------------

_YEARS_OPEN = '{"experience_requirement":{"min_years_experience":'
_YEARS_CLOSE = ',"experience_requirement_evidence":"stated by '


def years_reply(before: str, after: str) -> str:
    return (
        f"{text(_YEARS_OPEN + before)} || CAST(n_chars % 9 AS VARCHAR) || "
        f"{text(after + _YEARS_CLOSE)} || job_id || {text(chr(34) + '}}')}"
    )


_FULL = (
    text(
        '{"language_requirements":[{"language":"English","level":"C1",'
        '"requirement":"required","evidence":"en '
    )
    + " || job_id || "
    + text(
        '"},{"language":"German","requirement":"good_to_have","evidence":"de"}],'
        '"experience_requirement":{"min_years_experience":'
    )
    + " || CAST(n_chars % 9 AS VARCHAR) || "
    + text(
        ',"experience_requirement_evidence":"years"},"higher_education_requirement":'
        '{"is_masters_or_phd_required":false,"education_requirement_evidence":null},'
        '"relocation_requirement":{"visa_sponsorship_available":true,'
        '"relocation_assistance_provided":null,"work_mode":"hybrid",'
        '"relocation_evidence":"move"}}'
    )
)
view(
    "bare",
    f"""
SELECT job_id, CASE n_chars % 10
  WHEN 0 THEN {_FULL}
  WHEN 1 THEN {years_reply('', '')}
  WHEN 2 THEN {years_reply('"', '"')}
  WHEN 3 THEN {years_reply('', '.0')}
  WHEN 4 THEN {years_reply('', '.5')}
  WHEN 5 THEN {text(
    '{"higher_education_requirement":{"is_masters_or_phd_required":1},'
    '"relocation_requirement":{"visa_sponsorship_available":"true",'
    '"relocation_assistance_provided":"no","relocation_evidence":"m"}}')}
  WHEN 6 THEN {text(
    '{"experience_requirement":{"min_years_experience":2},'
    '"relocation_requirement":{"work_mode":"flexible","relocation_evidence":"m"}}')}
  WHEN 7 THEN {text(
    '{"language_requirements":[{"language":"Dutch","requirement":"maybe"}],'
    '"higher_education_requirement":"none"}')}
  WHEN 8 THEN {text('{"note":"extra","experience_requirement":null,'
    '"language_requirements":[{"language":"English","evidence":"e ')} || job_id || {text(
    '"},{"language":"Dutch","level":null,"evidence":"d"}]}')}
  ELSE 'Sorry, nothing found for ' || job_id END AS bare
FROM texts""",
    "texts",
)
oracle("strip_fences", "SELECT job_id, bare FROM bare", "bare")


def jtype(path: str, doc: str = "j") -> str:
    return f"json_type({doc}, '{path}')"


def jtext(path: str, doc: str = "j") -> str:
    return f"json_extract_string({doc}, '{path}')"


NUMBERS = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')"


def jmissing(path: str, doc: str = "j") -> str:
    return f"coalesce({jtype(path, doc)}, 'NULL') = 'NULL'"


def ok_int(path: str) -> str:
    return (
        f"({jmissing(path)} OR {jtype(path)} = 'BOOLEAN' OR ({jtype(path)} IN {NUMBERS} "
        f"OR {jtype(path)} = 'VARCHAR') AND regexp_matches({jtext(path)}, "
        f"{text(INTEGER_TEXT)}) AND try_cast(regexp_replace(trim({jtext(path)}), '\\.0+$', '') AS INTEGER) IS NOT NULL)"
    )


def bool_text(path: str) -> str:
    return (
        f"CASE WHEN {jtype(path)} IN {NUMBERS} THEN regexp_replace({jtext(path)}, "
        f"'\\.0+$', '') ELSE lower({jtext(path)}) END"
    )


def ok_bool(path: str) -> str:
    return (
        f"({jmissing(path)} OR {jtype(path)} = 'BOOLEAN' OR {jtype(path)} IN {NUMBERS} AND "
        f"{bool_text(path)} IN ('0', '1') OR {jtype(path)} = 'VARCHAR' AND {bool_text(path)} "
        f"IN {one_of(TRUE_TEXTS + FALSE_TEXTS)})"
    )


def ok_text(path: str, doc: str = "j") -> str:
    return f"coalesce({jtype(path, doc)} = 'VARCHAR', false)"


def ok_optional(path: str, doc: str = "j") -> str:
    return f"({jmissing(path, doc)} OR {jtype(path, doc)} = 'VARCHAR')"


def ok_choice(path: str, allowed: tuple[str, ...], doc: str = "j") -> str:
    return (
        f"({jtype(path, doc)} IS NULL OR {jtype(path, doc)} = 'VARCHAR' AND "
        f"{jtext(path, doc)} IN {one_of(allowed)})"
    )


def read_bool(path: str) -> str:
    return (
        f"CASE WHEN {bool_text(path)} IN {one_of(TRUE_TEXTS)} THEN true "
        f"WHEN {bool_text(path)} IN {one_of(FALSE_TEXTS)} THEN false END"
    )


def _checks() -> str:
    from placewright import schemas

    lines = [
        f"CASE WHEN NOT ({jmissing('$.' + LANGUAGES)} OR {jtype('$.' + LANGUAGES)} = 'ARRAY') "
        f"THEN '{LANGUAGES}: not a list' END"
    ]
    items = f"CAST(json_extract(j, '$.{LANGUAGES}') AS JSON[])"
    for field, good in {
        "language": ok_text("$.language", "x"),
        "level": ok_optional("$.level", "x"),
        "requirement": ok_choice("$.requirement", schemas.REQUIREMENT_LEVELS, "x"),
        "evidence": ok_text("$.evidence", "x"),
    }.items():
        lines.append(
            f"CASE WHEN {jtype('$.' + LANGUAGES)} = 'ARRAY' AND list_contains("
            f"list_transform({items}, lambda x: {good}), false) "
            f"THEN '{LANGUAGES}.{field}: invalid' END"
        )
    good_by_field = {
        "min_years_experience": ok_int,
        "experience_requirement_evidence": ok_text,
        "is_masters_or_phd_required": ok_bool,
        "education_requirement_evidence": ok_optional,
        "visa_sponsorship_available": ok_bool,
        "relocation_assistance_provided": ok_bool,
        "work_mode": lambda p: ok_choice(p, schemas.WORK_MODES),
        "relocation_evidence": ok_text,
    }
    for part, fields in FIELDS.items():
        kind = jtype(f"$.{part}")
        lines.append(
            f"CASE WHEN NOT ({jmissing('$.' + part)} OR {kind} = 'OBJECT') "
            f"THEN '{part}: not an object' END"
        )
        lines += [
            f"CASE WHEN {kind} = 'OBJECT' AND NOT {good_by_field[f](f'$.{part}.{f}')} "
            f"THEN '{part}.{f}: invalid' END"
            for f in fields
        ]
    return "concat_ws('; ',\n    " + ",\n    ".join(lines) + ")"


_Y, _D = f"$.{EXPERIENCE}.min_years_experience", f"$.{EDUCATION}.is_masters_or_phd_required"
_V, _R = (
    f"$.{RELOCATION}.visa_sponsorship_available",
    f"$.{RELOCATION}.relocation_assistance_provided",
)
view(
    "parsed",
    f"""
SELECT job_id, j, CASE WHEN j IS NULL THEN 'reply: not JSON'
  WHEN json_type(j) <> 'OBJECT' THEN 'reply: not an object' ELSE
  {_checks()} END AS errors
FROM (SELECT job_id, CASE WHEN json_valid(bare) THEN CAST(bare AS JSON) END AS j FROM bare)""",
    "bare",
)
view(
    "replied",
    f"""
SELECT job_id, j, errors, errors = '' AS ok,
  CASE WHEN errors = '' THEN json_array_length(j, '$.{LANGUAGES}') END AS languages,
  CASE WHEN errors = '' THEN
    CAST(regexp_replace(trim({jtext(_Y)}), '\\.0+$', '') AS INTEGER) END AS min_years,
  CASE WHEN errors = '' THEN {read_bool(_D)} END AS degree,
  CASE WHEN errors = '' THEN {read_bool(_V)} END AS visa,
  CASE WHEN errors = '' THEN {read_bool(_R)} END AS relocation,
  CASE WHEN errors = '' AND {jtype('$.' + RELOCATION)} = 'OBJECT'
    THEN coalesce({jtext(f'$.{RELOCATION}.work_mode')}, 'unknown') END AS work_mode
FROM parsed""",
    "parsed",
)
oracle("validate_extractions", "SELECT * EXCLUDE (j) FROM replied", "replied")
oracle(
    "extraction_outcomes",
    """
SELECT CASE WHEN ok THEN 'processed' ELSE 'failed' END AS outcome,
  nullif(errors, '') AS reason, count(*) AS postings
FROM replied GROUP BY ALL""",
    "replied",
)
view(
    "flat",
    f"""
SELECT r.job_id, min_years AS min_experience_years,
  {jtext(f'$.{EXPERIENCE}.experience_requirement_evidence', 'r.j')}
    AS experience_requirement_text,
  e.requires_only_english, e.language_requirement_text, degree AS requires_advanced_degree,
  {jtext(f'$.{EDUCATION}.education_requirement_evidence', 'r.j')}
    AS education_requirement_text,
  visa AS visa_sponsorship_available, relocation AS relocation_assistance_provided,
  work_mode, {jtext(f'$.{RELOCATION}.relocation_evidence', 'r.j')} AS relocation_evidence
FROM replied r LEFT JOIN (
  SELECT job_id, bool_and(lower({jtext('$.language', 'x')}) = 'english')
      AS requires_only_english,
    string_agg({jtext('$.evidence', 'x')}, ' | ' ORDER BY i) AS language_requirement_text
  FROM (SELECT job_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i
    FROM (SELECT job_id, CAST(json_extract(j, '$.{LANGUAGES}') AS JSON[]) AS xs FROM replied
      WHERE ok))
  WHERE coalesce({jtext('$.requirement', 'x')}, 'required') = 'required'
  GROUP BY job_id) e ON e.job_id = r.job_id
WHERE ok""",
    "replied",
)
oracle("flatten_metadata", "SELECT * FROM flat", "flat")
oracle(
    "upsert_metadata",
    """
SELECT *, 1 AS seq FROM flat
UNION ALL SELECT *, 0 FROM metadata WHERE job_id NOT IN (SELECT job_id FROM flat)""",
    "flat",
    "metadata",
)
oracle(
    "bucketed_upsert",
    """
SELECT *, 1 AS seq FROM flat
UNION ALL SELECT *, 0 FROM metadata WHERE job_id NOT IN (SELECT job_id FROM flat)""",
    "flat",
    "metadata",
)
oracle(
    "rebuild_metadata",
    "SELECT *, has_experience OR has_education OR has_relocation AS has_metadata FROM rebuilt",
    "rebuilt",
)

# ---- rules ------------------------------------------------------------------------------------

oracle(
    "only_english",
    """
SELECT job_id, requires_only_english, language_requirement_text
FROM ads LEFT JOIN english USING (job_id)""",
    "ads",
    "english",
)
oracle(
    "extract_experience",
    "SELECT job_id, min_years, evidence FROM ads LEFT JOIN years USING (job_id)",
    "ads",
    "years",
)
for _key, _view, _column in (
    ("extract_degree", "degrees", "degree"),
    ("extract_visa", "visas", "visa"),
    ("extract_relocation", "moves", "relocation"),
):
    oracle(
        _key,
        f"SELECT job_id, value AS {_column}, evidence FROM ads LEFT JOIN {_view} USING (job_id)",
        "ads",
        _view,
    )
oracle(
    "extract_work_mode",
    """
SELECT job_id, coalesce(value, 'unknown') AS work_mode, evidence
FROM ads LEFT JOIN modes USING (job_id)""",
    "ads",
    "modes",
)
oracle(
    "extract_languages",
    """
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY pos, nth) - 1 AS position,
  language, level, requirement, s AS evidence
FROM named""",
    "named",
)
oracle(
    "enrich_gaps",
    """
SELECT candidate_id, m.job_id,
  CASE WHEN has_metadata THEN 'stored' ELSE 'extracted' END AS metadata_from,
  CASE WHEN has_metadata THEN m.min_years ELSE r.min_experience_years END AS min_years,
  CASE WHEN has_metadata THEN m.work_mode ELSE r.work_mode END AS work_mode
FROM matches m JOIN ruled r ON r.job_id = m.job_id""",
    "matches",
    "ruled",
)
oracle(
    "extract_batch",
    """
SELECT * FROM metadata
UNION ALL SELECT * FROM ruled WHERE job_id NOT IN (SELECT job_id FROM metadata)""",
    "metadata",
    "ruled",
)
oracle(
    "extract_batch_model",
    """
SELECT job_id, batch, CASE n % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 2 ELSE 3 END AS attempts,
  CASE WHEN n % 5 = 3 THEN 'failed' ELSE 'processed' END AS outcome,
  CASE WHEN n % 5 = 3 THEN 'reply: not an object' END AS reason,
  CASE WHEN n % 5 IN (0, 1, 4) THEN n % 9 END AS min_experience_years,
  CASE WHEN n % 5 IN (0, 1, 4) THEN 'stated' END AS experience_requirement_text,
  CASE WHEN n % 5 = 2 THEN 'remote' END AS work_mode,
  CASE WHEN n % 5 = 2 THEN 'said' END AS relocation_evidence
FROM (SELECT job_id, length(description) AS n FROM texts
  WHERE description <> '' AND job_id NOT IN (SELECT job_id FROM metadata)) pending,
  (VALUES (1), (2)) AS batches(batch) WHERE batch = 1 OR n % 5 = 3""",
    "texts",
    "metadata",
)
oracle(
    "extraction_ledger",
    """
SELECT job_id, 'processed' AS outcome, CAST(NULL AS VARCHAR) AS reason, 1 AS batch_id
FROM ruled WHERE job_id NOT IN (SELECT job_id FROM metadata)""",
    "ruled",
    "metadata",
)
oracle(
    "evidence_grounding",
    """
SELECT e.job_id, field, evidence, contains(description, evidence) AS grounded FROM (
  SELECT job_id, 'language' AS field, s AS evidence FROM named
  UNION ALL SELECT job_id, 'experience', experience_requirement_text FROM ruled
  UNION ALL SELECT job_id, 'education', education_requirement_text FROM ruled
  UNION ALL SELECT job_id, 'relocation', relocation_evidence FROM ruled
  UNION ALL SELECT job_id, 'experience', experience_evidence FROM rebuilt
  UNION ALL SELECT job_id, 'education', education_evidence FROM rebuilt WHERE has_education
  UNION ALL SELECT job_id, 'relocation', relocation_evidence FROM rebuilt) e
JOIN ads ON ads.job_id = e.job_id WHERE evidence <> ''""",
    "named",
    "ruled",
    "rebuilt",
    "ads",
)
oracle(
    "evidence_spans",
    """
SELECT job_id, field, evidence, CAST(place - 1 AS INTEGER) AS start, CAST(place - 1 + length(quote) AS INTEGER) AS stop FROM (
  SELECT e.job_id, field, evidence, regexp_replace(trim(evidence), '[ \\t\\n\\r\\f]+', ' ' || chr(10) || ' ', 'g') AS quote,
    position(quote IN regexp_replace(description, '[ \\t\\n\\r\\f]+', ' ' || chr(10) || ' ', 'g')) AS place FROM (
    SELECT job_id, 'language' AS field, s AS evidence FROM named
    UNION ALL SELECT job_id, 'experience', experience_requirement_text FROM ruled
    UNION ALL SELECT job_id, 'education', education_requirement_text FROM ruled
    UNION ALL SELECT job_id, 'relocation', relocation_evidence FROM ruled) e
  JOIN ads ON ads.job_id = e.job_id WHERE evidence <> '')""",
    "named",
    "ruled",
    "ads",
)
oracle(
    "extraction_accuracy",
    """
SELECT coalesce(field, 'overall') AS field, count(*) FILTER (WHERE hit) AS correct,
  count(*) AS total, round(count(*) FILTER (WHERE hit) / count(*), 4) AS accuracy
FROM (
  SELECT 'min_experience_years' AS field,
    true_years IS NOT DISTINCT FROM min_experience_years AS hit
  FROM ads JOIN ruled USING (job_id)
  UNION ALL SELECT 'only_english_required',
    true_english IS NOT DISTINCT FROM requires_only_english FROM ads JOIN ruled USING (job_id)
  UNION ALL SELECT 'higher_education_req',
    true_degree IS NOT DISTINCT FROM requires_advanced_degree
  FROM ads JOIN ruled USING (job_id))
GROUP BY ROLLUP (field)""",
    "ads",
    "ruled",
)

# ---- injected functions -------------------------------------------------------------------------

oracle(
    "extract_with_retry",
    """
SELECT job_id, CASE WHEN length(description) % 3 < 2
    THEN '{"length": ' || CAST(length(description) AS VARCHAR) || '}' END AS reply,
  CASE length(description) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS attempts,
  length(description) % 3 < 2 AS ok,
  CASE WHEN length(description) % 3 = 2 THEN 'reply is not an object' END AS error
FROM texts""",
    "texts",
)
oracle(
    "reviewed_drafts",
    """
SELECT candidate_id, job_id,
  'cover letter v' || CAST(least(length(description) % 4 + 1, 3) AS VARCHAR) || ' '
    || CAST(length(description) AS VARCHAR) AS draft,
  length(description) % 4 < 3 AS approved,
  CASE WHEN length(description) % 4 = 3 THEN 'version 3 claims too much' ELSE '' END AS issues,
  least(length(description) % 4, 2) AS rounds, false AS rejected
FROM matches""",
    "matches",
)

# ---- incremental --------------------------------------------------------------------------------

oracle(
    "incremental_ingest",
    """
SELECT CAST(doc_id AS VARCHAR) AS job_id, source AS title, lang AS company,
  text AS description
FROM documents WHERE lang <> 'fr'""",
)
oracle(
    "incremental_status",
    "SELECT candidate_id, job_id, seq, status, notes FROM status",
    "status",
)
oracle(
    "channel_handoffs",
    """
WITH staged AS (
  SELECT *, min(CASE WHEN turn % 4 = 3 THEN turn END) OVER (
    PARTITION BY conv_id ORDER BY turn RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS handoff_turn
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
)
SELECT conv_id AS thread_id, handoff_turn,
  (max(struct_pack(t := turn, x := text)) FILTER (WHERE role = 'assistant' AND text <> '')).x AS summary,
  count(*) AS messages
FROM staged WHERE handoff_turn IS NOT NULL GROUP BY conv_id, handoff_turn""",
)
