"""Small deterministic stand-ins for injected models.

They are pure functions of their input, so what they do to every row can also
be said in SQL.
"""

from __future__ import annotations

from placewright.functions.prompts import TEXT_MARK
from placewright.operators.inference import RETRY_NOTE, WordHashEncoder

PROMPT = "Posting:\n" + TEXT_MARK
_NOTE_START = RETRY_NOTE.split("%s")[0]


def encoder() -> WordHashEncoder:
    return WordHashEncoder(dimensions=64)


def shy_model():
    """Answers at once, only after a correction, or never, by text length."""

    def answer(prompt: str) -> str:
        text, *notes = prompt.split(_NOTE_START)
        kind = (len(text) - len("Posting:\n")) % 3
        if kind == 0 or (kind == 1 and notes):
            return '{"length": %d}' % (len(text) - len("Posting:\n"))
        return "no idea"

    return answer


def must_be_object(reply: str) -> str | None:
    return None if reply.startswith("{") else "reply is not an object"


def drafter():
    def write(kind, description, resume, earlier, issues):
        if earlier is None:
            return f"{kind} v1 {len(description)}"
        version = int(earlier.split(" ")[-2][1:]) + 1
        return f"{kind} v{version} {len(description)}"

    return write


def judge():
    """Accepts the first, second, third or no version, by text length."""

    def review(kind, draft, description, resume):
        version = int(draft.split(" ")[-2][1:])
        wanted = len(description) % 4 + 1
        if version >= wanted:
            return True, []
        return False, [f"version {version} claims too much"]

    return review


def erring_model():
    """Replies by text length: valid, corrected after one or two errors, after a failed call, or never valid."""
    years = '{"experience_requirement":{"min_years_experience":%s,"experience_requirement_evidence":"stated"}}'
    move = (
        '{"relocation_requirement":{"visa_sponsorship_available":null,"relocation_assistance_provided":null,'
        '"work_mode":"%s","relocation_evidence":"said"}}'
    )

    def answer(prompt: str) -> str:
        text, *notes = prompt.split(_NOTE_START)
        length, told = len(text) - len("Posting:\n"), "".join(notes)
        kind = length % 5
        if kind == 1 and "min_years_experience: invalid" not in told:
            return years % '"many"'
        if kind == 2 and "work_mode: invalid" not in told:
            return move % "beach" if "not JSON" in told else "no idea"
        if kind == 2:
            return move % "remote"
        if kind == 3:
            return "[]"
        if kind == 4 and "line is busy" not in told:
            raise RuntimeError("line is busy")
        return years % (length % 9)

    return answer
