"""Word lists, orders and predicates over roles, questions and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verb tags of the Penn Treebank.
VERB_TAGS = ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD")
#: Auxiliary verbs, by what they are forms of.
DO_VERBS = ("do", "does", "doing", "did", "done")
BE_VERBS = ("be", "being", "been", "am", "'m", "is", "'s", "ai", "are", "'re", "was", "were")
WILL_VERBS = ("will", "'ll", "wo")
HAVE_VERBS = ("have", "having", "'ve", "has", "had", "'d")
MODAL_VERBS = ("can", "ca", "could", "may", "might", "must", "shall", "should", "ought", "would", "'d")
AUXILIARIES = tuple(dict.fromkeys(DO_VERBS + BE_VERBS + WILL_VERBS + HAVE_VERBS + MODAL_VERBS))
#: Prepositions that may lead an argument.
PREPOSITIONS = ("about", "above", "across", "after", "against", "along", "around", "at", "before", "behind", "between", "by", "for", "from", "in", "inside", "into", "near", "of", "on", "outside", "over", "through", "to", "toward", "under", "with", "without")
#: Texts of whole arguments that the side rules take out: modals with phrasal ones, negations, discourse.
MODALS = tuple(dict.fromkeys(MODAL_VERBS + WILL_VERBS + ("won't", "can't", "have", "going", "used", "gonna", "gon", "'ve", "able")))
NEGATIONS = ("no", "not", "n't", "never", "no longer")
DISCOURSE = (
    "also", "however", "too", "as well", "but", "and", "as we've seen before", "instead", "on the other hand", "for instance",
    "or", "though", "hence", "furthermore", "moreover", "thus", "so", "nonetheless", "regardless", "rather", "ironically", "indeed",
    "certainly", "frankly", "similarly", "thereby", "therefore", "specifically", "particularly", "in particular", "in turn", "and so",
    "as a result", "after all", "in addition", "in contrast", "in other words", "for example", "for one thing", "for one",
    "in this case", "in that case", "in any case", "in any event", "in fact", "of course",
    "oh my god", "ah", "damn", "uh", "um", "gosh", "oh my gosh", "oh gosh",
)
LEXICA = {"negation": NEGATIONS, "modals": MODALS, "discourse": DISCOURSE}
#: Syntactic functions of adjuncts.
ADJUNCT_FUNCTIONS = ("TMP", "MNR", "LOC", "DIR")
#: The order in which roles are listed; others come after them, by name.
ROLE_ORDER = (
    "ARG0", "ARG1", "ARG2", "ARG3", "ARG4", "ARGM-LOC", "ARGM-MNR", "ARGM-ADV", "ARGM-PNC", "ARGM-CAU", "ARGM-TMP", "ARGM-DIS",
    "ARGM-DIR", "ARGM-EXT", "ARGM-MOD", "ARGM-NEG", "ARGM-PRD", "ARG5", "ARGA",
)
#: Roles left out when question words are compared with roles.
NO_WH_ROLES = ("ARG4", "ARG5", "ARGA", "ARGM-NEG", "ARGM-MOD", "ARGM-DIS", "ARGM-PRD", "ARGM-EXT")
#: Groups of roles; all others are Other.
ROLE_GROUPS = {
    "Arg": ("ARG0", "ARG1", "ARG2", "ARG3", "ARG4", "ARG5"),
    "Mod": ("ARGM-TMP", "ARGM-ADV", "ARGM-MNR", "ARGM-LOC", "ARGM-PNC", "ARGM-CAU", "ARGM-DIR"),
    "Lex": ("ARGM-NEG", "ARGM-MOD", "ARGM-DIS"),
}


def is_verbal(pos: Column) -> Column:
    return pos.isin(*VERB_TAGS)


def continues_other(role: Column) -> Column:
    """Roles that refer to or continue another one."""
    return role.rlike("^[RC]-")


def is_irrelevant_role(role: Column) -> Column:
    """The verb itself, or discourse, negation, modal, referring and continued roles."""
    return role.isin("V", "REL") | role.rlike("DIS|NEG|MOD|C-|R-")


def is_relevant(role: Column, lemma: Column, begin: Column, end: Column, verb_index: Column) -> Column:
    """Relevant role of a verb that is no auxiliary, on a span without the verb itself."""
    return ~is_irrelevant_role(role) & ~lemma.isin(*AUXILIARIES) & ~((begin <= verb_index) & (verb_index < end))


def role_group(role: Column) -> Column:
    """Arg, Mod, Lex or Other."""
    return F.coalesce(*[F.when(role.isin(*names), group) for group, names in ROLE_GROUPS.items()], F.lit("Other"))


def role_rank(role: Column) -> Column:
    """Place in ROLE_ORDER, 100 for all others."""
    place = F.lit(100)
    for i, r in reversed(list(enumerate(ROLE_ORDER))):
        place = F.when(role == r, i).otherwise(place)
    return place


def verb_type(lemma: Column, sense: Column | None = None) -> Column:
    """The lemma, or lemma.sense."""
    return lemma if sense is None else F.concat_ws(".", lemma, sense)


def lemma_of(verb_type: Column) -> Column:
    """The text before the first dot."""
    return F.substring_index(verb_type, ".", 1)


def wh_word(question: Column) -> Column:
    return F.regexp_extract(question, "^(how much|how long|[a-z]+)", 1)


def without_function_tag(label: Column) -> Column:
    """A constituent label up to its first hyphen."""
    return F.substring_index(label, "-", 1)


def span_text(tokens: Column, begin: Column, end: Column) -> Column:
    """Tokens of [begin, end) in lower case, with blanks between."""
    return F.lower(F.array_join(F.slice(tokens, begin + 1, end - begin), " "))


def sentence_order(sentence_id: Column) -> list[Column]:
    """Sort keys of a sentence id: the part before the last colon, and the number after it (-1 where there is none)."""
    number = F.coalesce(F.regexp_extract(sentence_id, ":([0-9]+)$", 1).try_cast("int"), F.lit(-1))
    return [F.regexp_replace(sentence_id, ":[^:]*$", ""), number]
