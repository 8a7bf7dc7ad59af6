"""Column functions over text: normal forms, tokens, predicates and acronym rules. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
STOPWORDS = (
    "the", "a", "an", "of", "and", "or", "for", "to", "in", "on", "at", "by", "with", "from", "as", "is", "are", "be", "this", "that", "these", "those",
    "its", "it", "into", "per", "via", "not", "no", "than", "then", "but", "if", "so", "such", "may", "can", "will", "shall", "each",
)
COMMON_ACRONYMS = ("US", "USA", "ID", "OK", "TBD", "NA", "FAQ", "PDF", "URL", "FAA", "DOD", "DOT", "OEM")
LEGAL_SUFFIXES = ("inc", "llc", "corp", "corporation", "company", "co", "ltd", "gmbh", "plc", "lp", "llp")
GLOSSARY_HEADER_WORDS = (
    "acronym", "acronyms", "abbreviation", "abbreviations", "abbr", "term", "terms", "symbol", "symbols", "definition", "definitions", "description", "meaning",
    "expansion", "expanded", "full form", "stands for", "title", "acronym/abbreviation", "item", "no", "no.", "ref", "page",
)
WORD = r"[A-Za-z]+(?:['\-][A-Za-z]+)*"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9&./'\-]*"

#: White space as Unicode has it, with the four separator controls.
SPACE = r"(?U)[\s\x1C-\x1F]+"


def ws(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def tokens(text: Column) -> Column:
    """Tokens of letters, digits and inner marks; a trailing full stop stays, commas and brackets fall away."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def is_stopword(token: Column) -> Column:
    return F.lower(token).isin(*STOPWORDS)


def is_significant(token: Column) -> Column:
    """Not a stopword, and with a letter."""
    return ~is_stopword(token) & token.rlike("[A-Za-z]")


def is_capitalised(token: Column) -> Column:
    return token.rlike("^[A-Z]")


def is_spec(token: Column) -> Column:
    """Letters and digits mixed, or a lone letter: part numbers and column heads, not words."""
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return mixed | token.rlike(r"^[-/.,()]*[A-Za-z][-/.,()]*$")


def token_class(token: Column) -> Column:
    """One letter for what n-gram rules need of a token: x spec, t stopword, C capitalised, s other significant, n the rest."""
    return F.when(is_spec(token), "x").when(is_stopword(token), "t").when(~token.rlike("[A-Za-z]"), "n").when(is_capitalised(token), "C").otherwise("s")


def classes(token_array: Column) -> Column:
    """The token classes of an array as one string, a letter for each."""
    return F.array_join(F.transform(token_array, token_class), "")


def gram_ok(kinds: Column) -> Column:
    """Whether tokens of these classes may form a phrase.

    Two or more, none spec, no stopword at either end, two or more
    significant ones, and capitalised at least half of those and two.
    """
    size = F.length(kinds)
    caps = size - F.length(F.replace(kinds, F.lit("C"), F.lit("")))
    significant = caps + size - F.length(F.replace(kinds, F.lit("s"), F.lit("")))
    return (size >= 2) & ~kinds.contains("x") & ~kinds.startswith("t") & ~kinds.endswith("t") & (significant >= 2) & (caps >= 2) & (caps * 2 >= significant)


def candidate_gram(token_array: Column) -> Column:
    return gram_ok(classes(token_array))


def propose_acronym(phrase: Column) -> Column:
    """First letters of the significant tokens and of their parts after - and /, in capitals."""
    kept = F.filter(F.split(phrase, " "), is_significant)
    parts = F.flatten(F.transform(kept, lambda t: F.split(t, "[-/]")))
    initials = F.transform(F.filter(parts, lambda p: p.rlike("^[A-Za-z]")), lambda p: F.upper(F.substring(p, 1, 1)))
    return F.array_join(initials, "")


def norm_expansion(text: Column) -> Column:
    return F.lower(ws(text))


def significant_words(text: Column) -> Column:
    return F.filter(F.split(ws(text), " "), is_significant)


def defines(acronym: Column, expansion: Column) -> Column:
    """Whether an expansion is plausible: same first letter, and as many significant words as letters, give or take one."""
    letters = F.regexp_replace(acronym, "[^A-Za-z]", "")
    kept = significant_words(expansion)
    first = F.lower(F.substring(F.get(kept, F.lit(0)), 1, 1)) == F.lower(F.substring(letters, 1, 1))
    return (F.length(letters) > 0) & (F.size(kept) > 0) & first & (F.abs(F.size(kept) - F.length(letters)) <= 1)


def initials(expansion: Column) -> Column:
    """Lower-case initials of the words that aren't stopwords, parts after - and / included."""
    kept = F.filter(F.split(ws(expansion), " "), lambda t: ~is_stopword(t))
    parts = F.flatten(F.transform(kept, lambda t: F.split(t, "[-/]")))
    return F.array_join(F.transform(F.filter(parts, lambda p: p.rlike("^[A-Za-z]")), lambda p: F.lower(F.substring(p, 1, 1))), "")


def snippet(text: Column, word: Column, width: int = 40) -> Column:
    """The surroundings of a word's first place, with an ellipsis on sides that are cut; else the text's beginning."""
    at = F.instr(text, word)
    lo = F.greatest(at - width, F.lit(1))
    hi = F.least(F.length(text), at + F.length(word) + (width - 1))
    cut = F.concat(F.when(lo > 1, "…").otherwise(""), ws(F.substring(text, lo, hi - lo + 1)), F.when(hi < F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(ws(F.substring(text, 1, 2 * width)))


def org_key(name: Column) -> Column:
    """An organisation's name in lower case without full stops, commas and legal forms."""
    plain = F.regexp_replace(F.lower(name), "[.,]", "")
    return ws(F.regexp_replace(plain, r"\b(" + "|".join(LEGAL_SUFFIXES) + r")\b", ""))


def md_cell(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|"))


def is_glossary_title(text: Column) -> Column:
    """Headings such as "List of Acronyms and Abbreviations:"."""
    first, more = "acronyms?|abbreviations?|nomenclature|glossary|definitions?", "acronyms?|abbreviations?|definitions?|terms?"
    return F.trim(text).rlike(rf"(?i)^(?:(?:list|table) of\s+)?(?:{first})(?:\s*(?:,|&|and)\s*(?:{more}))*\s*:?\s*$")


def looks_like_acronym(text: Column) -> Column:
    """Two to twelve characters that read as an acronym: not a header word, and with a mark or digit or mostly capitals."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return text.rlike(r"^[A-Za-z][A-Za-z0-9&./\-]{1,11}$") & ~F.lower(text).isin(*GLOSSARY_HEADER_WORDS) & ((letters < F.length(text)) | (capitals * 2 >= letters))


def gloss_pair(text: Column) -> Column:
    """(acronym, expansion) of a row "A | B" or a line "A B...", or null."""
    cells = F.filter(F.transform(F.split(F.trim(text), r" \| "), F.trim), lambda c: c != "")
    barred = F.trim(text).contains(" | ")
    left = F.when(barred, F.get(cells, F.lit(0))).otherwise(F.regexp_extract(text, r"^\s*(\S+)\s+\S", 1))
    right = F.when(barred, F.get(cells, F.lit(1))).otherwise(F.regexp_extract(text, r"(?s)^\s*\S+\s+(\S.*)$", 1))
    acronym = F.regexp_replace(F.trim(left), "[.:]+$", "")
    expansion = F.regexp_replace(F.trim(right), r"^[-\u2013\u2014:\s]+", "")
    single = ~expansion.contains(" ")
    ok = looks_like_acronym(acronym) & ~F.lower(expansion).isin(*GLOSSARY_HEADER_WORDS) & (expansion != acronym) & (F.length(expansion) >= 3)
    ok = ok & ~(single & (F.length(expansion) <= F.length(acronym) + 2)) & (F.length(acronym) < F.length(expansion))
    return F.when(ok, F.struct(acronym.alias("acronym"), expansion.alias("expansion")))


def safe_error(kind: Column, message: Column) -> Column:
    """A message that may be shown: that of a value error, else a general one."""
    return F.when(kind == "ValueError", message).otherwise(F.lit("processing failed"))
