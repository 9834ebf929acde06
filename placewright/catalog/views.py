"""The engine's input tables, derived by Spark from the test tables.

Every view covers its whole source tables. Attributes the test tables do not
have (years, work mode, answers ...) are computed from columns they do have.
``oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

from functools import cached_property
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.functions.metadata import rebuild
from placewright.operators.compatibility import with_metadata
from placewright.operators.keyed import hydrate
from placewright.session import ship_package

FIRST_LISTING_MS = 1_704_067_200_000
TOP_K = 10


def by_case(selector: Column, values: list, cast: str | None = None) -> Column:
    """``values[selector]``; None stays NULL."""
    result = None
    for index, value in enumerate(values):
        lit = F.lit(value) if not isinstance(value, Column) else value
        result = (
            F.when(selector == index, lit)
            if result is None
            else result.when(selector == index, lit)
        )
    return result.cast(cast) if cast else result


def names(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def profile(candidate_id: Column) -> list[Column]:
    """Preference columns of a candidate, spread over all kinds."""
    return [
        F.when(candidate_id % 4 != 0, (candidate_id % 4 + 2).cast("int")).alias(
            "experience_years"
        ),
        F.when(candidate_id % 2 == 1, names("The", "en"))
        .otherwise(names())
        .alias("must_have_skills"),
        F.when(candidate_id % 4 == 1, names("Europe"))
        .when(candidate_id % 4 == 2, names("  "))
        .when(candidate_id % 4 == 3, names("NATION_3", "asia"))
        .otherwise(names())
        .alias("preferred_locations"),
        (candidate_id % 5 == 0).alias("open_to_relocation"),
        (candidate_id % 2 == 0).alias("requires_visa_sponsorship"),
    ]


YEARS_TEXT = [
    None,
    "Twelve years of sailing experience are asked for, ports included.",
    "Applicants show 6-8 yrs of experience on night shifts.",
    "Our orchard has stood for 40 years. One year of experience in pruning is enough.",
    "A minimum of 1.5 years in a bakery, though 4 years would be welcome.",
    "Half a lifetime with looms helps.",
]
YEARS_TRUTH = [None, 12, 6, 1, 1, None]
DEGREE_TEXT = [
    None,
    "The laboratory takes chemists with a doctorate only; a doctorate is mandatory.",
    "Holding an MSc is an advantage in the drawing office.",
    "A BSc in surveying is needed, nothing beyond it.",
    "No diploma is asked for.",
]
DEGREE_TRUTH = [None, True, False, False, None]
LANGUAGE_TEXT = [
    "Italian is needed at the counter. Some English helps.",
    None,
    "The crew reads Norwegian charts now and then.",
    "Native Polish is mandatory. Czech would be nice to have.",
    "English is essential for the radio.",
    "Swedish is not necessary.",
    "Danish would be a bonus; English is a must.",
]
ENGLISH_TRUTH = [False, None, None, False, True, None, True]
VISA_TEXT = ["We cannot sponsor a permit.", None, "For this berth visa sponsorship is offered."]
MOVE_TEXT = [
    None,
    "The yard pays a relocation package for families.",
    None,
    "Relocation is not provided by the guild.",
]
MODE_TEXT = [
    "Everyone is on-site at the mill.",
    None,
    "The desk is remote, all week.",
    "We keep a hybrid week with two days at the harbour.",
]


class Views:
    #: Schemas seen in this process, by path.
    schemas: ClassVar[dict[str, T.StructType]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        ship_package(spark)
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in self.schemas:  # reading footers is a job of its own
            self.schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.schemas[path]).parquet(path)

    # ---- postings and their requirements -------------------------------

    @cached_property
    def postings(self) -> DataFrame:
        return self._postings(self.table("documents"))

    def _postings(self, doc: DataFrame) -> DataFrame:
        part = self.table("part")
        nation, region = self.table("nation"), self.table("region")
        place = nation.join(region, nation.n_regionkey == region.r_regionkey)
        return (
            doc.join(part, part.p_partkey == doc.doc_id, "left")
            .join(place, F.col("n_nationkey") == F.col("doc_id") % 25, "left")
            .select(
                F.col("doc_id").cast("string").alias("job_id"),
                F.concat("p_type", F.lit(" "), "p_name").alias("title"),
                F.col("p_brand").alias("company"),
                F.col("text").alias("description"),
                F.concat("n_name", F.lit(", "), "r_name").alias("location"),
                F.col("r_name").alias("country"),
                F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id").alias(
                    "application_url"
                ),
                (F.lit(FIRST_LISTING_MS) + F.col("n_chars") * 60_000).alias("posted_ms"),
                "n_chars",
                "lang",
            )
        )

    @cached_property
    def texts(self) -> DataFrame:
        """``job_id, description, n_chars, lang`` without any join."""
        return self._texts(self.table("documents"))

    @staticmethod
    def _texts(documents: DataFrame) -> DataFrame:
        return documents.select(
            F.col("doc_id").cast("string").alias("job_id"),
            F.col("text").alias("description"),
            "n_chars",
            "lang",
        )

    @cached_property
    def metadata(self) -> DataFrame:
        doc = self.table("documents").select("doc_id", "lang", "n_chars")
        n, job = F.col("n_chars"), F.col("doc_id").cast("string")
        return doc.join(self.table("labels"), "doc_id").select(
            job.alias("job_id"),
            F.when(n % 5 != 0, (n % 9).cast("int")).alias("min_experience_years"),
            F.when(n % 11 == 0, "")
            .when(n % 13 != 0, F.concat(F.lit("ev exp "), job))
            .alias("experience_requirement_text"),
            F.when(F.col("lang") == "en", True)
            .when(F.col("lang") == "de", False)
            .alias("requires_only_english"),
            F.when(
                F.col("lang").isin("en", "de"), F.concat(F.lit("ev lang "), "lang")
            ).alias("language_requirement_text"),
            F.when(F.col("toxic") == 0, F.col("quality") == 0).alias(
                "requires_advanced_degree"
            ),
            F.when(n % 7 != 0, F.concat(F.lit("ev edu "), job)).alias(
                "education_requirement_text"
            ),
            by_case(n % 3, [False, True, None]).alias("visa_sponsorship_available"),
            F.when(n % 2 == 1, True).alias("relocation_assistance_provided"),
            by_case(n % 4, ["remote", "hybrid", "onsite", "unknown"]).alias("work_mode"),
            F.when(n % 6 == 0, "")
            .otherwise(F.concat(F.lit("ev move "), job))
            .alias("relocation_evidence"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("job_id"), "embedding"
        )

    @cached_property
    def candidates(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("candidate_id"),
            F.col("embedding").alias("resume_embedding"),
            *profile(F.col("vec_id")),
        )

    @cached_property
    def ads(self) -> DataFrame:
        """Whole texts followed by requirement sentences, with the truth."""
        n = F.col("n_chars")
        return self.texts.select(
            "job_id",
            F.concat_ws(
                "\n",
                "description",
                by_case(n % 6, YEARS_TEXT),
                by_case(n % 5, DEGREE_TEXT),
                by_case(n % 7, LANGUAGE_TEXT),
                by_case(n % 3, VISA_TEXT),
                by_case(n % 4, MOVE_TEXT),
                by_case(F.floor(n / 5) % 4, MODE_TEXT),
            ).alias("description"),
            by_case(n % 6, YEARS_TRUTH, "int").alias("true_years"),
            by_case(n % 5, DEGREE_TRUTH, "boolean").alias("true_degree"),
            by_case(n % 7, ENGLISH_TRUTH, "boolean").alias("true_english"),
        )

    # ---- payloads and replies ------------------------------------------

    @cached_property
    def search_pages(self) -> DataFrame:
        """A page holds at most 100 postings: ids are unique."""
        doc = self.table("documents").select("doc_id", "n_chars")
        urn = F.concat(F.lit("urn:li:card:("), "doc_id", F.lit(",SEARCH)"))
        card = F.struct(
            F.lit("x.JobCard").alias("$type"),
            F.struct(urn.alias("*jobPostingCard")).alias("jobCardUnion"),
        )
        promo = F.struct(
            F.lit("x.PromoCard").alias("$type"),
            F.struct(F.lit("urn:li:promo:(0,AD)").alias("*jobPostingCard")).alias(
                "jobCardUnion"
            ),
        )
        shown = F.when(F.col("n_chars") % 10 == 0, F.array(card, promo)).otherwise(
            F.array(card)
        )
        pages = doc.groupBy(F.floor(F.col("doc_id") / 100).alias("page_no")).agg(
            F.flatten(F.collect_list(shown)).alias("elements"),
            F.count("*").alias("total"),
        )
        payload = F.struct(
            F.struct(F.struct("total").alias("paging"), F.col("elements")).alias("data")
        )
        return pages.select("page_no", F.to_json(payload).alias("payload"))

    @cached_property
    def detail_payloads(self) -> DataFrame:
        n, p = F.col("n_chars"), self.postings
        apply = F.struct(
            by_case(
                n % 3, [F.lit(""), F.lit(None).cast("string"), F.col("application_url")]
            ).alias("companyApplyUrl"),
            F.when(n % 3 == 0, F.concat(F.lit("https://easy.example/"), "job_id")).alias(
                "easyApplyUrl"
            ),
        )
        data = F.struct(
            F.struct(F.when(n % 19 != 0, F.col("description")).alias("text")).alias(
                "description"
            ),
            F.col("title"),
            F.col("location").alias("formattedLocation"),
            F.col("posted_ms").alias("originalListedAt"),
            F.lit("LISTED").alias("jobState"),
            F.when(n % 3 != 1, apply).alias("applyMethod"),
            F.struct(F.when(n % 4 != 0, F.col("company")).alias("companyName")).alias(
                "companyDetails"
            ),
        )
        entity = F.struct(
            F.lit("com.linkedin.voyager.organization.Company").alias("$type"),
            F.concat("company", F.lit(" Inc")).alias("name"),
        )
        other = F.struct(F.lit("x.Geo").alias("$type"), F.lit("Somewhere").alias("name"))
        included = F.when(n % 8 == 0, F.array(other)).otherwise(F.array(other, entity))
        text = F.to_json(F.struct(data.alias("data"), included.alias("included")))
        broken = F.substring(text, F.lit(1), F.length(text) - 5)
        return p.select(
            "job_id", F.when(n % 17 == 0, broken).otherwise(text).alias("payload")
        )

    @cached_property
    def state_payloads(self) -> DataFrame:
        ev = self._events()
        state = F.when(F.col("event_type") == "error", "CLOSED").otherwise("LISTED")
        payload = F.to_json(F.struct(F.struct(state.alias("jobState")).alias("data")))
        return ev.select("job_id", "seq", payload.alias("payload"))

    @cached_property
    def replies(self) -> DataFrame:
        """Model replies of ten kinds, from valid to no JSON at all."""
        n = F.col("n_chars")
        years, job = (n % 9).cast("string"), F.col("job_id")

        def exp(value: str) -> list[Column]:
            return [
                F.lit('{"experience_requirement":{"min_years_experience":' + value[0]),
                years,
                F.lit(
                    value[1] + ',"experience_requirement_evidence":"stated by '
                ),
                job,
                F.lit('"}}'),
            ]

        full = F.concat(
            F.lit(
                '{"language_requirements":[{"language":"English","level":"C1",'
                '"requirement":"required","evidence":"en '
            ),
            job,
            F.lit(
                '"},{"language":"German","requirement":"good_to_have",'
                '"evidence":"de"}],"experience_requirement":{"min_years_experience":'
            ),
            years,
            F.lit(
                ',"experience_requirement_evidence":"years"},'
                '"higher_education_requirement":{"is_masters_or_phd_required":false,'
                '"education_requirement_evidence":null},"relocation_requirement":'
                '{"visa_sponsorship_available":true,'
                '"relocation_assistance_provided":null,"work_mode":"hybrid",'
                '"relocation_evidence":"move"}}'
            ),
        )
        kinds = [
            full,
            F.concat(F.lit("```json\n"), *exp(("", "")), F.lit("\n```")),
            F.concat(*exp(('"', '"'))),
            F.concat(*exp(("", ".0"))),
            F.concat(*exp(("", ".5"))),
            F.lit(
                '{"higher_education_requirement":{"is_masters_or_phd_required":1},'
                '"relocation_requirement":{"visa_sponsorship_available":"true",'
                '"relocation_assistance_provided":"no","relocation_evidence":"m"}}'
            ),
            F.lit(
                '{"experience_requirement":{"min_years_experience":2},'
                '"relocation_requirement":{"work_mode":"flexible",'
                '"relocation_evidence":"m"}}'
            ),
            F.lit(
                '{"language_requirements":[{"language":"Dutch","requirement":"maybe"}],'
                '"higher_education_requirement":"none"}'
            ),
            F.concat(
                F.lit(
                    '{"note":"extra","experience_requirement":null,'
                    '"language_requirements":[{"language":"English","evidence":"e '
                ),
                job,
                F.lit('"},{"language":"Dutch","level":null,"evidence":"d"}]}'),
            ),
            F.concat(F.lit("Sorry, nothing found for "), job),
        ]
        return self.texts.select("job_id", by_case(n % 10, kinds).alias("reply"))

    # ---- candidates' events ---------------------------------------------

    @cached_property
    def n_documents(self) -> int:
        """Read from the file footers."""
        return self.table("documents").count()

    def _job_of(self, user: Column, k: Column) -> Column:
        """A user's hundred jobs lie anywhere in the corpus; five jobs are everybody's."""
        anywhere = F.pmod(user * 7919 + k * 101, F.lit(self.n_documents))
        return F.when(k < 5, k).otherwise(anywhere).cast("string")

    def _events(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("candidate_id"),
            self._job_of(F.col("user_id"), F.get_json_object("props", "$.k").cast("bigint")).alias("job_id"),
            F.col("event_id").alias("seq"),
            "event_type",
            "value",
            "props",
        )

    @cached_property
    def people(self) -> DataFrame:
        """Candidates of the event views with their preferences."""
        ids = self.table("events").select(F.col("user_id").alias("candidate_id"))
        return ids.distinct().select("candidate_id", *profile(F.col("candidate_id")))

    @cached_property
    def pairs(self) -> DataFrame:
        """(candidate, job) pairs with any event, and a score."""
        return (
            self._events()
            .groupBy("candidate_id", "job_id")
            .agg((F.max("value") / 1000).alias("similarity_score"))
        )

    @cached_property
    def matches(self) -> DataFrame:
        """Shortlist: the ten best viewed jobs per candidate, with details."""
        viewed = (
            self._events()
            .where(F.col("event_type") == "view")
            .groupBy("candidate_id", "job_id")
            .agg((F.max("value") / 1000).alias("similarity_score"))
        )
        window = Window.partitionBy("candidate_id").orderBy(
            F.col("similarity_score").desc(), F.col("job_id").asc()
        )
        top = (
            viewed.withColumn("rank", F.row_number().over(window))
            .where(F.col("rank") <= TOP_K)
            .drop("rank")
        )
        return hydrate(with_metadata(top, self.metadata), self.postings).select(
            "candidate_id",
            "job_id",
            "title",
            "company",
            "location",
            "country",
            "description",
            "similarity_score",
            rebuild().alias("metadata"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        kind = F.col("event_type")
        pursue = (
            F.when(kind == "view", "True")
            .when(kind == "click", " yes ")
            .when(kind == "purchase", "1")
            .when(kind == "error", "false")
            .otherwise("no")
        )
        return self._events().select(
            "candidate_id",
            "job_id",
            "seq",
            pursue.alias("pursue"),
            F.concat("event_type", F.lit(" "), "seq").alias("reason"),
        )

    @cached_property
    def status_events(self) -> DataFrame:
        kind = F.col("event_type")
        status = (
            F.when(kind == "view", "shortlisted")
            .when(kind == "click", "tailored")
            .when(kind == "purchase", "applied")
            .when(kind == "error", "skipped")
            .otherwise("expired")
        )
        return self._events().select(
            "candidate_id",
            "job_id",
            "seq",
            status.alias("status"),
            F.when(F.col("seq") % 2 == 1, F.col("props")).alias("notes"),
        )

    @cached_property
    def artifact_deltas(self) -> DataFrame:
        kind = F.col("event_type")
        return self._events().select(
            "candidate_id",
            "job_id",
            "seq",
            F.when(kind == "view", F.concat(F.lit("R"), "seq")).alias("tailored_resume"),
            F.when(kind == "click", F.concat(F.lit("C"), "seq"))
            .when(kind == "signup", "")
            .alias("cover_letter"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """The last answer per pair; pairs without one stay unanswered."""
        kind = F.col("event_type")
        answer = (
            F.when(kind == "purchase", " APPROVE ")
            .when(kind == "click", "y")
            .when(kind == "error", "skip")
        )
        given = self._events().withColumn("answer", answer).where("answer IS NOT NULL")
        return given.groupBy("candidate_id", "job_id").agg(
            F.max_by("answer", "seq").alias("answer")
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("thread_id"), "turn", "role", "text"
        )

    # ---- arrivals ---------------------------------------------------------

    @cached_property
    def arrivals(self) -> DataFrame:
        """Posting rows landing in order; keys repeat, some lack a company."""
        return self.table("lineitem").select(
            F.col("l_partkey").cast("string").alias("job_id"),
            F.concat(F.lit("lot "), "l_orderkey", F.lit("/"), "l_linenumber").alias("title"),
            F.when(
                F.col("l_returnflag") != "R", F.concat(F.lit("supplier "), "l_suppkey")
            ).alias("company"),
            F.concat("l_linestatus", F.lit(" "), F.col("l_quantity").cast("int")).alias(
                "description"
            ),
            F.col("l_shipdate").alias("landed_at"),
        )

    @cached_property
    def arrival_order(self) -> list[Column]:
        return [F.col(c) for c in ("landed_at", "title", "company", "description")]
