"""Vocabulary of the domain, as configuration: an engine is given one and holds no words of its own."""

from __future__ import annotations

from dataclasses import dataclass, field

# These word lists decide results, so they are stated as they are.
STOP_WORDS = frozenset(
    "a an and are as at be based by can could do does for from had has have how i if in is it me my of on or say says "
    "the their there they this to under was what when where which who will with would manual policy please tell about "
    "county program assistance department may might must shall should i'm im i've ive while".split()
)
SYNONYMS = {
    "apply": ("application",),
    "qualify": ("eligible", "eligibility"),
    "qualified": ("eligible", "eligibility"),
    "eligible": ("eligibility",),
    "eligibility": ("eligible",),
    "assets": ("resources",),
    "asset": ("resource",),
    "deadline": ("period", "days", "time", "limit"),
    "time": ("period", "days"),
    "allow": ("give", "period", "days"),
    "exception": ("unless", "extended", "where"),
    "referral": ("referred", "supervisor"),
    "late": ("failed", "delay", "period"),
    "penalty": ("sanction", "reduction"),
    "punishment": ("sanction", "reduction"),
    "meeting": ("interview",),
    "homeless": ("fixed", "address"),
    "teenager": ("under", "18", "16", "17"),
    "minor": ("under", "18", "16", "17"),
    "challenge": ("review", "appeal"),
    "denial": ("refused", "determination", "review", "appeal"),
    "denied": ("refused", "determination", "review", "appeal"),
    "car": ("vehicle",),
    "cars": ("vehicles",),
    "outside": ("absent", "absence"),
    "away": ("absent", "absence"),
    "college": ("student", "education"),
    "savings": ("resource", "resources"),
    "saving": ("resource", "resources"),
    "earn": ("earnings", "income"),
    "live": ("resident", "residence"),
    "receive": ("payment", "award"),
    "benefit": ("award", "assistance"),
    "benefits": ("award", "assistance"),
    "old": ("age", "aged"),
    "age": ("aged",),
    "wage": ("earnings",),
    "wages": ("earnings",),
    "proof": ("evidence",),
    "prove": ("evidence",),
    "first": ("before",),
    "max": ("maximum", "limit", "exceed"),
    "maximum": ("limit", "exceed"),
    "help": ("assistance", "eligible", "eligibility"),
    "keep": ("continue", "remain"),
}
PHRASES = {
    "cut me off": ("suspend", "terminate", "termination"),
    "hand in": ("provide", "submit"),
    "turn in": ("provide", "submit"),
    "no fixed address": ("connection", "county"),
    "how long": ("period", "days", "weeks", "months"),
    "time limit": ("period", "days", "within"),
    "full time": ("full-time",),
    "how much assistance": ("award", "needs", "figure", "countable", "income"),
    "keep getting help": ("continue", "eligible", "eligibility", "award"),
    "keep receiving help": ("continue", "eligible", "eligibility", "award"),
}
GENERIC = frozenset("manual policy say state rule question exactly actually standard include including apply applicable program".split())
INTENT = frozenset("amount calendar day deadline figure how limit long many much month monthly percentage period rate threshold time week year what when where which who".split())
FORM = frozenset(
    "can cannot classify count cover do does few get give happen include includ list make made may must occur provide help "
    "keep receive remain require required say shall should tell treat treated will would".split()
)
ROLES = frozenset("applicant department household member person recipient".split())
NON_TOPICAL = frozenset(
    "about amount answer calendar day deadline detail exception few figure get have help it keep limit long many manual month "
    "much period policy question rate rule tell that them these thing this threshold those time week year".split()
)


@dataclass(frozen=True)
class Lexicon:
    """Word lists and expansions; a deployment adds the names of its own programmes to ``stop_words`` and ``generic``."""

    stop_words: frozenset = STOP_WORDS
    synonyms: dict = field(default_factory=lambda: dict(SYNONYMS))
    phrases: dict = field(default_factory=lambda: dict(PHRASES))
    generic: frozenset = GENERIC
    intent: frozenset = INTENT
    form: frozenset = FORM
    roles: frozenset = ROLES
    non_topical: frozenset = NON_TOPICAL

    @property
    def non_subject(self) -> frozenset:
        return self.generic | self.intent | self.form


DEFAULT = Lexicon()
