"""Question and passage predicates (F2-F6), each one pattern over a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import DEFAULT, Lexicon
from .text import focus_question, policy_ids, term_set, words

# These patterns decide results, so they are stated as they are.
NUMERIC_QUESTION = r"(?i)\b(how (?:many|much|long)|time limit|deadline|amount|rate|percentage|threshold|limit)\b"
NUMERIC_PASSAGE = r"(?i)(?:\$\s*[0-9]|\b[0-9]+(?:\.[0-9]+)?\s*(?:calendar\s+|working\s+)?(?:days?|weeks?|months?|years?|per\s*cent|percent|%))"
LIST_QUESTION = r"(?i)\b(which|what (?:are|is|income|resources?|conditions?|evidence|ways?|documents?|types?|kinds?))\b"
NUMERIC_INTENT = r"(?i)\b(how (?:many|much|long)|deadline|amount|rate|percentage|threshold|limit|days?|weeks?|months?|years?|per cent|percent)\b"
BOOLEAN_QUESTION = r"(?i)^\s*(can|could|does|do|is|are|may|must|will|would)\b"
CLASSIFICATION_QUESTION = r"(?i)\b(count(?:ed)? as|counted|classif(?:y|ied)|disregard(?:ed)?|eligible|eligibility|qualify)\b"
CLASSIFICATION_PASSAGE = r"(?i)\b(count(?:ed|able)?|treated as|disregard(?:ed)?|eligible|ineligible|not allowable)\b"
EXCEPTION_QUESTION = r"(?i)\b(exception|including|unless|beyond|over|good cause)\b"
EXCEPTION_PASSAGE = r"(?i)\b(except|unless|extended|where|good cause|outside .* control)\b"
EXCEPTION_SCOPE = r"(?i)\b(extended to|except|unless|where|up to|first)\b"
MODALITY = r"(?i)\b(must|may|shall|is not|are not|eligible|ineligible|required|prohibited)\b"
CONTINUATION_QUESTION = r"(?i)\b(keep (?:getting|receiving)|continue|still|remain)\b"
CONTINUATION_PASSAGE = r"(?i)\b(continues? to satisfy|continues? to be eligible|remains? (?:eligible|a household member))\b"
METHOD_QUESTION = r"(?i)\b(how (?:do|can|may|should) (?:i|we|a person|an applicant) apply|ways? (?:to apply|an application may be made)|application methods?)\b"
METHOD_PASSAGE = r"(?i)\ban application may be made\b"
_PEOPLE = r"(?:(?:i|we|someone|an? (?:applicant|person)|applicants?|people)\s+)?"
ACCESS_QUESTION = rf"(?i)\b(?:(?:where|how)\s+(?:can|do|may|should)\s+{_PEOPLE}(?:get|find|access|obtain)|who\s+(?:can|do|should|may)\s+{_PEOPLE}(?:ask|contact|call))\b"
ACCESS_TOPIC = r"(?i)\b(?:support|referral|services?|assistance|help)\b"
ACCESS_PASSAGE = r"(?i)\b(?:contact|call|in person|online|by (?:post|mail|telephone|phone|email)|through (?:the )?department(?:'s)? (?:online )?portal|at (?:any|a|the) (?:district )?office|an application may be made)\b"
COMPOUND = r"(?i),|\band\b|\bincluding\b"
INELIGIBLE = r"(?i)\b(?:(?:is|are) not eligible|ineligible|excluded)\b"
ELIGIBLE = r"(?i)\b(?:is|are) eligible\b"
PERSONAL = r"(?i)\b(am i|will i|exactly how much)\b"
PRONOUN_FOLLOW_UP = r"(?i)^\s*(?:does|is|are|can|could|will|would|should)\s+(?:it|this|that|these|those|they|them)\b"
_READ = r"(?:please\s+)?(?:show|quote|read|display|summarize|summarise|explain)\s+(?:(?:clause|provision)\s+)?§?[0-9]+\.[0-9]+\.[0-9]+"
#: A command to read a clause, without the questions that ask the same.
READ_COMMAND = rf"(?i)^\s*{_READ}\s*[?.!]*\s*$"
LOOKUP = (
    rf"(?i)^\s*(?:{_READ}"
    r"|what\s+does\s+(?:(?:clause|provision)\s+)?§?[0-9]+\.[0-9]+\.[0-9]+\s+(?:say|state|mean|contain|provide)"
    r"|what\s+is\s+(?:in\s+)?(?:clause|provision)\s+§?[0-9]+\.[0-9]+\.[0-9]+)\s*[?.!]*\s*$"
)
INDIVIDUAL_DETERMINATION = r"(?i)\b(?:am i|will i|do i|would i)\s+(?:be\s+)?(?:eligible|qualify|get|receive|approved|entitled)\b|\bexactly how much (?:will|would|do) i\b"
CASE_RECORD = r"(?i)\bmy (?:case|application|file|record|award|appeal)(?:'s)?\s+(?:status|outcome|decision|number)\b|\b(?:status|outcome) of my (?:case|application|appeal)\b"


def ascii_classes(pattern: str) -> str:
    """``pattern`` as RE2, and so SQL, reads it: words end at the first letter beyond ASCII, a vertical tab is no blank, case is folded in all of Unicode."""
    word = "(?-iu:[0-9A-Za-z_])"
    edge = f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"
    return pattern.replace(r"\b", edge).replace(r"\s", r"[\t\n\f\r ]").replace("(?i)", "(?iu)")


def lookup_ids(question: Column, focus: bool = True, pattern: str = LOOKUP) -> Column:
    """the clause identifiers that a question merely asks to read; without ``focus`` a leading instruction stays in it."""
    focused = focus_question(question) if focus else question
    three = F.filter(policy_ids(focused), lambda i: F.size(F.split(i, r"\.")) == 3)
    return F.when(focused.rlike(pattern), three).otherwise(F.array().cast("array<string>"))


def is_underspecified(question: Column, lexicon: Lexicon = DEFAULT, focus: bool = True, lookup: str = LOOKUP, follow_up: str = PRONOUN_FOLLOW_UP) -> Column:
    """a follow-up by pronoun, or words that name no topic."""
    focused = focus_question(question) if focus else question
    terms = term_set(focused, lexicon=lexicon)
    vague = (F.size(terms) > 0) & (F.size(F.array_except(terms, words(lexicon.non_topical))) == 0)
    return (F.size(lookup_ids(question, focus, lookup)) == 0) & (focused.rlike(follow_up) | vague)


def needs_case_facts(question: Column) -> Column:
    """asks about one's own case, which no rule settles."""
    return question.rlike(INDIVIDUAL_DETERMINATION) | question.rlike(CASE_RECORD)


def answer_alignment(question: Column, text: Column, raw: Column) -> Column:
    """How well a passage's form fits what the question asks for; the first intent that holds decides."""
    compound, modal = question.rlike(COMPOUND), text.rlike(MODALITY)
    excepted = question.rlike(EXCEPTION_QUESTION) & text.rlike(EXCEPTION_PASSAGE)
    listed = F.contains(text, F.lit("(a)")) | F.contains(raw, F.lit("|")) | text.rlike(r"(?i)\bfollowing\b|\bmay be made\b")
    pick = lambda c, yes, no: F.when(c, F.lit(yes)).otherwise(F.lit(no))
    numeric = F.when(text.rlike(NUMERIC_PASSAGE), 1.0).when(excepted, 0.9).when(compound & modal, 0.75).otherwise(0.2)
    return (
        F.when(question.rlike(NUMERIC_QUESTION), numeric)
        .when(question.rlike(LIST_QUESTION), pick(listed, 1.0, 0.35))
        .when(question.rlike(CLASSIFICATION_QUESTION) & ~compound, pick(text.rlike(CLASSIFICATION_PASSAGE), 1.0, 0.25))
        .when(question.rlike(METHOD_QUESTION), pick(text.rlike(METHOD_PASSAGE), 1.0, 0.2))
        .when(question.rlike(ACCESS_QUESTION) & question.rlike(ACCESS_TOPIC), pick(text.rlike(ACCESS_PASSAGE), 1.0, 0.2))
        .when(question.rlike(CONTINUATION_QUESTION), pick(text.rlike(CONTINUATION_PASSAGE), 1.0, 0.25))
        .when(question.rlike(BOOLEAN_QUESTION), pick(modal, 1.0, 0.35))
        .when(excepted, 0.95)
        .otherwise(pick(modal | text.rlike(r"(?i)\bis\b|\bare\b"), 0.8, 0.55))
    )


def finding_matches(question: Column, patterns: Column, phrases: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """trigger patterns if there are any, else a phrase of two words or more, else enough shared terms."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[-–—]", " ")
    q = plain(question)
    said = F.exists(phrases, lambda p: (F.size(F.split(F.trim(plain(p)), r"\s+")) >= 2) & F.contains(q, plain(p)))
    topic = F.array_distinct(F.flatten(F.transform(phrases, lambda p: term_set(plain(p), True, lexicon))))
    needed = F.when(F.size(topic) <= 2, 1).when(F.size(topic) <= 5, 2).otherwise(3)
    shared = F.size(F.array_intersect(term_set(q, True, lexicon), topic)) >= needed
    triggered = F.exists(patterns, lambda p: F.regexp_like(q, F.concat(F.lit("(?i)"), p)))
    return F.when(F.size(patterns) > 0, triggered).otherwise(said | shared)


def next_step_key(question: Column, decision: Column) -> Column:
    """which route a refused or conflicting question is sent along."""
    q = F.lower(question)
    return (
        F.when(decision == "CONFLICT", "conflict")
        .when(q.rlike(r"\b(appeal|review|challenge|den(?:y|ied|ial)|refus)"), "appeals")
        .when(q.rlike(r"\b(eligib|qualif|apply|application|income|resource)"), "eligibility")
        .otherwise("default")
    )
