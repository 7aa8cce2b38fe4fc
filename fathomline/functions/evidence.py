"""Designers' names found in text, by patterns of falling confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that results depend on.
DESIGN = ["to a design", "to a designs", "to design", "to designs", "design", "designs", "designed", "work", "works"]
PLAN = ["design", "designs", "plan", "plans"]
ACTS = ["signed", "exhibited", "attributed", "produced", "prepared", "executed", "approval"]
LINKS = ["by", "to", "of"]
ROLES = ["architectural practice", "architectural firm", "architects", "architect", "engineers", "engineer", "surveyors", "surveyor"]
CONTEXT = ["designed", "designs", "design", "architects", "architect", "architectural", "plans", "plan", "prepared", "drawn"]
OTHER_WORK = ["stained glass", "altar fittings", "altar fitting", "altar", "mosaic", "windows", "window", "joinery", "ironwork", "wall box", "post box", "waterpump", "memorial window", "high altar"]
NO_NAMES = [
    "subscription", "catholic", "church", "chapel", "reverend", "rev", "revd", "dr", "pp", "a.d", "bally", "the", "a", "an", "parochial", "grant",
    "voluntary", "lord", "bishop", "clergy", "congregation", "parishioners", "donations", "means", "local", "board", "commissioners",
    "subscriptions", "ecclesiastical", "presbyterian", "order", "monastery", "abbey", "religious", "funds", "support", "assistance", "labour",
    "tithe", "cemetery", "graveyard", "school", "house", "brothers", "sisters", "christian", "baptist", "methodist", "congregational", "quaker",
    "ordnance", "survey", "office", "public", "council", "committee", "submission", "proposal", "estimate", "contractor", "builder", "councils",
    "commission", "commissioner", "ecumenical", "roman", "of",
]
ONLY_AS = r"(?i)named\s+only\s+as"
TITLES = ["Sir", "Lady", "Lord", "St.", "Saint"]

_WORD = r"[A-Z][A-Za-z'’.\-]*"
_NAME = rf"({_WORD}(?:\s+(?:(?:and|&)\s+)?{_WORD}){{0,4}})"


def _any(words: list[str]) -> str:
    """Any of these words, in any case, with any white space between their parts."""
    return "(?i:" + "|".join(r"\s+".join(w.split()) for w in words) + ")"


#: What may stand between the verb and the name: the, and a role with up to five words before it.
_ROLE = rf"(?:(?i:the)\s+)?(?:(?:[A-Za-z'’.\-&]+\s+){{0,5}}{_any(ROLES)}(?:\s+named\s+(?:only\s+)?as\s+|[,;:]?\s+))?"
_ASIDE = r"(?:\s+\([^)]{1,40}\))?"
#: Patterns in the order they are tried, with the confidence of what they find; the part of the sentence before is the first group, the name the second.
TIERS = [
    (rf"([^.;]*?)\b{_any(DESIGN)}{_ASIDE}\s+(?:{_any(ACTS)}{_ASIDE}\s+)?{_any(LINKS)}\s+{_ROLE}{_NAME}", "high"),
    (rf"([^.;]*?)\b{_any(PLAN)}[^.;]{{0,80}}?\b{_any(ACTS)}{_ASIDE}\s+{_any(LINKS)}\s+{_ROLE}{_NAME}", "high"),
    (rf"([^.;]*?\b{_any(CONTEXT)}\W{{1,36}}?)(?i:by)\s+{_ROLE}{_NAME}", "medium"),
]


def attribution(text: Column) -> Column:
    """Struct of name and confidence: the first name that holds of the first pattern with any; null if there is none.

    A match does not count where its sentence speaks of other work before it, nor one
    whose name is none (see clean_name).
    """
    options = []
    for pattern, confidence in TIERS:
        whole, before, names = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (0, 1, 2))
        found_at = F.arrays_zip(whole.alias("whole"), before.alias("before"), names.alias("name"))
        made = F.transform(found_at, lambda x: F.when(~x["before"].rlike(rf"\b{_any(OTHER_WORK)}\b"), clean_name(x["name"], x["whole"].rlike(ONLY_AS))))
        found = F.get(F.filter(made, lambda x: x.isNotNull()), F.lit(0))
        options.append(F.when(found.isNotNull(), F.struct(found.alias("name"), F.lit(confidence).alias("confidence"))))
    return F.coalesce(*options)


def _is_name(words: Column, single: Column) -> Column:
    """Whether words are a name: two or more (one, if the source says that it is all), none of them one that no name has, and three with a title."""
    bare = lambda w: F.btrim(F.lower(w), F.lit(".,"))
    wrong = F.exists(words, lambda w: bare(w).isin(NO_NAMES) & ~w.rlike("^[A-Z][.]$"))
    return ((F.size(words) >= 2) | (single & (F.element_at(words, 1) != ""))) & ~wrong & ~(F.element_at(words, 1).isin(TITLES) & (F.size(words) < 3))


def clean_name(name: Column, single: Column | None = None) -> Column:
    """A name without what follows it, marks at its end, repeated blanks and sons in trade; null if it is none.

    single: whether one word may be a name, as where a source names someone only so.
    It ends at a comma, a parenthesis, a possessive, or where a sentence does, which
    is not behind an initial.
    """
    alone = F.lit(False) if single is None else single
    bare = F.trim(F.regexp_extract(F.trim(name), r"^(.*?)(?:,\s|\(|['’]s\s|$)", 1))
    bare = F.regexp_replace(bare, r"^(.*?[^A-Z.])\.\s+[A-Z].*$", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[.]+$", ""), r"\s+", " ")
    firm = F.regexp_replace(bare, r"\s+(?:and|&)\s+(?:Sons?|Co[.]?)$", "")
    return reduce(lambda x, test: F.when(test, x), [_is_name(F.split(bare, " "), alone), _is_name(F.split(firm, " "), alone)], firm)


def name_key(name: Column) -> Column:
    """Surname and initials, which spellings of one name share: dots part initials."""
    parts = F.filter(F.split(F.translate(name, ".", " "), r"\s+"), lambda x: x != "")
    initials = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.upper(F.substring(p, 1, 1)))
    return F.concat_ws(" ", F.element_at(parts, -1), F.array_join(initials, ""))
