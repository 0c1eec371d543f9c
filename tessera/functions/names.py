"""Business names: abbreviations, dotted acronyms and legal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, clean_text, col, map_tokens, null_if_empty, squeeze

#: Abbreviations of names.
NAME_SHORT = {"pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated"}
#: Legal acronyms whose dots have become spaces, longer ones first.
DOTTED = ("s a s u", "s a r l", "e u r l", "l l c", "l l p", "p l c", "s c i", "s n c", "s a s", "s a")
#: Legal forms, longer ones first, and what each is called.
LEGAL_FORMS = {
    "private limited": "private limited",
    "limited liability company": "llc",
    "limited liability partnership": "llp",
    "public limited company": "plc",
    "one person company": "opc",
    "limited": "limited",
    "incorporated": "incorporated",
    "corporation": "corporation",
    "company": "company",
    "llc": "llc",
    "llp": "llp",
    "plc": "plc",
    "opc": "opc",
    "sarl": "sarl",
    "sasu": "sasu",
    "sas": "sas",
    "eurl": "eurl",
    "sci": "sci",
    "snc": "snc",
    "sa": "sa",
}
#: Forms that may stand first in a French name.
LEADING_FORMS = ("sarl", "sas", "sasu", "sa", "eurl", "sci", "snc")


def expand_name(c: str | Column) -> Column:
    """Whole-token abbreviations of a cleaned name written out."""
    return map_tokens(col(c), NAME_SHORT)


def join_dotted(c: str | Column) -> Column:
    """Legal acronyms that dots had split into letters, put together again."""
    s = col(c)
    for spaced in DOTTED:
        s = F.regexp_replace(s, f"(^| ){spaced}($| )", "$1" + spaced.replace(" ", "") + "$2")
    return s


def normalize_name(raw: str | Column) -> Column:
    return join_dotted(expand_name(clean_text(raw)))


def is_country(country: str | Column, name: str) -> Column:
    return F.lower(blank(country)) == name


def split_legal(name: str | Column, country: str | Column | None = None) -> tuple[Column, Column]:
    """(core, form) of a normalised name. A trailing form counts if a token stands before it; a
    French name without one may have a leading form. form is null if there is none."""
    n = col(name)
    any_form = "|".join(f.replace(" ", r"\s+") for f in LEGAL_FORMS)
    found = F.regexp_extract(n, rf"(?U)^.+?\s+({any_form})$", 1)
    called = F.create_map(*[F.lit(x) for kv in LEGAL_FORMS.items() for x in kv])
    form = F.coalesce(F.try_element_at(called, found), null_if_empty(found))
    core = F.regexp_replace(n, rf"(?U)^(.+?)\s+(?:{any_form})$", "$1")
    if country is None:
        return core, form
    first = "|".join(LEADING_FORMS)
    lead = null_if_empty(F.regexp_extract(n, rf"(?U)^({first})\s+.+$", 1))
    leads = is_country(country, "france") & form.isNull() & lead.isNotNull()
    return (
        F.when(leads, F.regexp_replace(n, rf"(?U)^(?:{first})\s+(.+)$", "$1")).otherwise(core),
        F.when(leads, lead).otherwise(form),
    )


#: Legal words that matching leaves out of a name.
MATCH_WITHOUT = (
    "private", "limited", "pvt", "ltd", "llp", "llc", "inc", "incorporated", "corp", "corporation",
    "company", "co", "plc", "sarl", "sas", "sasu", "eurl", "sa", "gmbh", "www", "com", "net", "org",
    "http", "https",
)


def without_legal_words(c: str | Column) -> Column:
    """A cleaned name without legal words, wherever they stand."""
    return squeeze(F.regexp_replace(col(c), rf"(?U)\b(?:{'|'.join(MATCH_WITHOUT)})\b", " "))
