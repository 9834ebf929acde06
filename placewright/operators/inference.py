"""Injected functions run partition-wise: embed, extract, draft and review.

The functions are ordinary picklable callables. A *loader* is called once per
Python worker and returns the function, so a model is loaded once, not per
row or per batch. Rows are spread by Spark; a row's work never depends on
another row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.text import has_text

# Attempts and rounds.
EXTRACTION_ATTEMPTS = 3
REVISION_ROUNDS = 2
DIMENSIONS = 384
#: Results of loaders that a worker keeps at a time.
KEPT_MODELS = 4

Encoder = Callable[[list[str]], np.ndarray]

_loaded: dict[str, object] = {}


class Loaded:
    """A loader and the token under which its result is kept by a Python worker.

    The token is made once per use of an operator, so two loaders never share a result, however
    alike they look, and one loader runs once per worker and use.
    """

    def __init__(self, loader: Callable[[], object]) -> None:
        self.loader, self.token = loader, uuid.uuid4().hex

    def get(self) -> object:
        if self.token not in _loaded:
            while len(_loaded) >= KEPT_MODELS:  # of earlier queries of a long-lived worker
                _loaded.pop(next(iter(_loaded)))
            _loaded[self.token] = self.loader()
        return _loaded[self.token]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one as float32; zero rows stay zero."""
    wide = np.asarray(matrix, dtype=np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return (wide / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def embed(texts: Column, loader: Callable[[], Encoder]) -> Column:
    """Unit vectors of a text column through an injected encoder."""

    held = Loaded(loader)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = held.get()
        for batch in batches:
            vectors = unit_rows(encoder(batch.fillna("").tolist()))
            yield pd.Series(list(vectors))

    # never computed again for a filter that is pushed below it
    return encode.asNondeterministic()(texts)


def embed_postings(postings: DataFrame, loader: Callable[[], Encoder]) -> DataFrame:
    """``job_id, embedding`` of all postings that have a text."""
    return postings.where(has_text(F.col("description"))).select(
        "job_id", embed(F.col("description"), loader).alias("embedding")
    )


class WordHashEncoder:
    """Offline stand-in for a sentence model: hashed word counts.

    Words are cut at white space; the first four hex digits of a word's MD5
    name its dimension.
    """

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self._places: dict[str, int] = {}

    def _place(self, word: str) -> int:
        place = self._places.get(word)
        if place is None:
            digits = hashlib.md5(word.encode("utf-8")).hexdigest()[:4]
            place = int(digits, 16) % self.dimensions
            if len(self._places) < 200_000:
                self._places[word] = place
        return place

    def __call__(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros((len(texts), self.dimensions))
        for row, text in enumerate(texts):
            places = [self._place(word) for word in text.split()]
            if places:
                counts[row] = np.bincount(places, minlength=self.dimensions)
        return counts


#: What the prompt gains after a reply that did not validate.
RETRY_NOTE = (
    "\n\n## LAST REPLY REJECTED\n%s\n"
    "Send the JSON again with exactly this put right."
)

Model = Callable[[str], str]
#: reply text -> error text, or None when the reply is valid
ReplyCheck = Callable[[str], "str | None"]


def extract_with_retry(
    prompts: DataFrame,
    model_loader: Callable[[], Model],
    check: ReplyCheck,
    attempts: int = EXTRACTION_ATTEMPTS,
) -> DataFrame:
    """Ask a model for each prompt until its reply passes ``check``.

    prompts: ``job_id, prompt``. Returns ``job_id, reply, attempts, ok,
    error``; after the last attempt the row stays, with the last error.
    """

    held = Loaded(model_loader)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.get()
        for batch in batches:
            rows = []
            for job_id, prompt in zip(batch["job_id"], batch["prompt"]):
                error: str | None = None
                reply, used = "", 0
                while used < attempts:
                    used += 1
                    note = RETRY_NOTE % error if error else ""
                    try:
                        reply = model(prompt + note)
                        error = check(reply)
                    except Exception as problem:  # a model failure is a failed attempt
                        error = str(problem) or type(problem).__name__
                    if error is None:
                        break
                ok = error is None
                rows.append((job_id, reply if ok else None, used, ok, error))
            yield pd.DataFrame(
                rows, columns=["job_id", "reply", "attempts", "ok", "error"]
            ).astype({"attempts": "int32", "ok": "bool"})

    schema = "job_id string, reply string, attempts int, ok boolean, error string"
    return prompts.select("job_id", "prompt").mapInPandas(ask, schema)


#: (kind, job description, resume, earlier draft or None, issues) -> draft
Drafter = Callable[[str, str, str, "str | None", list], str]
#: (kind, draft, job description, resume) -> (approved, issues)
Judge = Callable[[str, str, str, str], tuple]


def reviewed_drafts(
    jobs: DataFrame,
    kind: str,
    drafter_loader: Callable[[], Drafter],
    judge_loader: Callable[[], Judge],
    rounds: int = REVISION_ROUNDS,
) -> DataFrame:
    """Draft a document per (candidate, job) and revise it while rejected.

    jobs: ``candidate_id, job_id, description, resume_text``. The last draft
    is returned with its verdict whether approved or not. Rows without a
    description get no draft and ``rejected`` set. A drafter or judge that
    fails leaves the last draft, not approved, with the error among the issues.
    """

    drafters, judges = Loaded(drafter_loader), Loaded(judge_loader)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drafter, judge = drafters.get(), judges.get()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if not row.description:
                    out.append((row.candidate_id, row.job_id, None, None, [], 0, True))
                    continue
                draft, approved, issues, done = None, None, [], 0
                try:
                    draft = drafter(kind, row.description, row.resume_text, None, [])
                    approved, issues = judge(kind, draft, row.description, row.resume_text)
                    while not approved and done < rounds:
                        draft = drafter(kind, row.description, row.resume_text, draft, issues)
                        approved, issues = judge(kind, draft, row.description, row.resume_text)
                        done += 1
                except Exception as problem:  # one failing call does not end the job
                    approved = False
                    issues = [*issues, f"failed: {problem or type(problem).__name__}"]
                out.append(
                    (row.candidate_id, row.job_id, draft, approved, issues, done, False)
                )
            yield pd.DataFrame(
                out,
                columns=[
                    "candidate_id",
                    "job_id",
                    "draft",
                    "approved",
                    "issues",
                    "rounds",
                    "rejected",
                ],
            )

    key_type = jobs.schema["candidate_id"].dataType.simpleString()
    schema = (
        f"candidate_id {key_type}, job_id string, draft string, approved boolean, "
        "issues array<string>, rounds int, rejected boolean"
    )
    return jobs.select("candidate_id", "job_id", "description", "resume_text").mapInPandas(
        work, schema
    )
