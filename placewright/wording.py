"""The sentences and formats of reports and notes.

Readers and downstream parsers rely on these texts, so they are stated here
as they must come out and used nowhere else in literal form.
``%s`` / ``%d`` places are filled by ``format_string``.
"""

# Fit report
FIT_HEADER = "Fit report for %s at %s (job %s):"
FIT_SCORE = "- resume similarity score: %.2f"
FIT_YEARS_UNKNOWN = "- experience: requires %d+ years; candidate years unknown"
FIT_YEARS_MET = "- experience: requires %d+ years; candidate has %d (meets requirement)"
FIT_YEARS_SHORT = "- experience: requires %d+ years; candidate has %d (short by %d)"
FIT_YEARS_NONE = "- experience: no explicit minimum stated"
FIT_DEGREE_REQUIRED = "- education: explicitly requires a Master's degree or PhD"
FIT_DEGREE_NOT_REQUIRED = "- education: advanced degree not required"
FIT_DEGREE_NOT_STATED = "- education: requirement not stated"
FIT_MODE = "- work mode: %s"
FIT_VISA_YES = "- visa: sponsorship available (candidate needs it)"
FIT_VISA_NO = "- visa: NO sponsorship, but candidate needs it — likely blocker"
FIT_VISA_UNKNOWN = "- visa: sponsorship unknown (candidate needs it)"
FIT_MODE_NOT_STATED = "- work mode / visa: not stated"
FIT_SKILLS_PRESENT = "- must-have skills mentioned: %s"
FIT_SKILLS_MISSING = "- must-have skills NOT mentioned: %s"
FIT_LOCATION = "- location: %s (candidate prefers: %s)"
NOT_SHORTLISTED = "No shortlisted job with job_id=%s."

# Posting text
POSTING_NO_TEXT = "Job %s has no stored description."
POSTING_TEXT = "%s at %s (%s):\n\n%s"
LOCATION_UNKNOWN = "location unknown"

# Shortlist and hand-off
SHORTLIST_EMPTY = "No matching jobs were found for this resume."
SHORTLIST_HEADER = "Shortlisted jobs:"
SHORTLIST_ENTRY = "%d. [%s] %s at %s"
SHORTLIST_SCORE = "score %.2f"
SHORTLIST_YEARS = "%dy exp"
DASH = " — "
HANDOFF_EMPTY = "No jobs were selected by the screener."
HANDOFF_HEADER = "Jobs selected for application preparation:"
HANDOFF_ENTRY = "- [%s] %s — screener's reason: %s"
HANDOFF_TITLE = "%s at %s"
HANDOFF_NO_DETAILS = "(job details missing)"

# Statuses and reviews
SCREENED_OUT = "screened out: %s"
REVIEW_APPROVED = "approved at human review"
REVIEW_SKIPPED = "skipped at human review"
POSTING_CLOSED = "Posting reported CLOSED by LinkedIn; removed from DB."
DECISION_LINE = "%s: %s — %s"
STATUS_LINE = "%s: %s"
DRAFT_PASSED = "passed the truthfulness review"
DRAFT_ISSUES = "review still flags issues after revision: %s"
DRAFT_ISSUE_UNSPECIFIED = "unspecified"
UNKNOWN_TITLE = "?"

# Answers read as yes
APPROVE_ANSWERS = ("y", "yes", "apply", "approve", "approved")
TRUE_WORDS = ("true", "1", "yes", "y")
