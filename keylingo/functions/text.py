"""Text column functions. Everything counts code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BOUNDARY, EXTENSIONS, LEADING, LETTERS, SCRIPTS

#: White space as the engine strips and collapses it.
SPACE = r"[ \t\n\x0B\f\r]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def strip_wiki_markup(text: Column) -> Column:
    """Templates, links to their labels, headings, tags, then white space: in this order."""
    for pattern, new in (
        (r"(?s)\{\{.*?\}\}", ""),
        (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
        (r"={2,}.*?={2,}", ""),
        (r"<[^>]+>", ""),
    ):
        text = F.regexp_replace(text, pattern, new)
    return strip(collapse(text))


def normalize_letters(text: Column, lang: str) -> Column:
    """Lower case, the language's letters alone; spaces go too, so n-grams span words."""
    return F.regexp_replace(F.lower(text), f"[^{LETTERS[lang]}]", "")


def normalize_by_language(text: Column, lang: Column, langs) -> Column:
    out = F.lit(None).cast("string")
    for one in langs:
        out = F.when(lang == one, normalize_letters(text, one)).otherwise(out)
    return out


def trigrams(text: Column) -> Column:
    """All windows of three characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))


def words(text: Column, lang: str, min_len: int = 2) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{LETTERS[lang]}]{{{min_len},}}"), F.lit(0))


def words_by_language(text: Column, lang: Column, langs, min_len: int = 2) -> Column:
    out = F.array().cast("array<string>")
    for one in langs:
        out = F.when(lang == one, words(text, one, min_len)).otherwise(out)
    return out


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def segments(text: Column) -> Column:
    """White-space and other runs in turn; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(f"{SPACE}+|[^ \\t\\n\\x0B\\f\\r]+"), F.lit(0))


def segments_with(text: Column, chars: str) -> Column:
    """The segments that hold one of some characters, none of them white space."""
    other = r"[^ \t\n\x0B\f\r]"
    return F.regexp_extract_all(text, F.lit(f"(?<!{other}){other}*?[{_ranges(chars)}]{other}*+"), F.lit(0))


def segmented(text: Column) -> Column:
    """Whether the text has two segments or more."""
    return text.rlike(f"{SPACE}[^ \\t\\n\\x0B\\f\\r]|[^ \\t\\n\\x0B\\f\\r]{SPACE}")


def runs(text: Column) -> Column:
    """Letter-or-number runs and runs between them; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "[](){}.!?\"\\^-&" else c for c in chars)


def _ranges(chars: str) -> str:
    """``_class`` with neighbouring characters as ranges, which regular expressions look up faster."""
    points = set(map(ord, chars))
    ends = zip(sorted(n for n in points if n - 1 not in points), sorted(n for n in points if n + 1 not in points), strict=True)
    return "".join(_class(chr(a)) + (f"-{_class(chr(b))}" if b > a else "") for a, b in ends)


def token_edges(text: Column) -> Column:
    """struct(leading, token, trailing): opening delimiters left, closing ones right.

    A trailing ``.`` or ``,`` right after a letter stays with the token, since on
    another layout it may be one.
    """
    leading = F.regexp_extract(text, f"^[{_class(LEADING)}]*", 0)
    rest = F.substring(text, F.length(leading) + 1, F.length(text))
    ends = _class(BOUNDARY + ",;")
    token = F.regexp_extract(rest, f"(?s)^(.*(?:\\p{{L}}[.,]|[^{ends}]))[{ends}]*$", 1)
    return F.struct(leading.alias("leading"), token.alias("token"), F.substring(rest, F.length(token) + 1, F.length(rest)).alias("trailing"))


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))).cast("long")


def script_counts(text: Column) -> dict[str, Column]:
    """Counts of Latin, Cyrillic, Hebrew, digits, white space, the rest, and all."""
    found = {
        "latin": count_of(text, SCRIPTS["en"]),
        "cyrillic": count_of(text, SCRIPTS["ru"]),
        "hebrew": count_of(text, SCRIPTS["he"]),
        "digits": count_of(text, "0-9"),
        "spaces": count_of(text, " \\t\\n\\x0B\\f\\r"),
    }
    total = F.length(text).cast("long")
    found["other"] = total - sum(found.values(), F.lit(0).cast("long"))
    found["total"] = total
    return found


def _once(text: Column, then) -> Column:
    """``then`` of the script counts, which are computed once however often it names them."""
    counts = F.struct(*(n.alias(name) for name, n in script_counts(text).items() if name in ("latin", "cyrillic", "hebrew")))
    return F.get(F.transform(F.array(counts), lambda n: then({k: n[k] for k in ("latin", "cyrillic", "hebrew")})), F.lit(0))


def dominant_script(text: Column, share: float = 0.85) -> Column:
    """The language whose script has at least the share of all scripted letters, else null."""

    def pick(n: dict[str, Column]) -> Column:
        scripted = n["latin"] + n["cyrillic"] + n["hebrew"]
        out = F.lit(None).cast("string")
        for lang, key in (("he", "hebrew"), ("ru", "cyrillic"), ("en", "latin")):
            out = F.when((scripted > 0) & (n[key] >= scripted * share), lang).otherwise(out)
        return out

    return _once(text, pick)


def charset_match(text: Column, lang: str, share: float = 0.7) -> Column:
    """Whether more than the share of all characters are in the language's script."""
    return (F.length(text) > 0) & (count_of(text, SCRIPTS[lang]) > F.length(text) * share)


def majority_language(text: Column) -> Column:
    """Strictly most letters of one language, else null."""
    low = F.lower(text)
    n = {lang: count_of(low, LETTERS[lang]) for lang in ("ru", "he", "en")}
    out = F.lit(None).cast("string")
    for lang in n:
        others = [n[x] for x in n if x != lang]
        out = F.when((n[lang] > others[0]) & (n[lang] > others[1]), lang).otherwise(out)
    return out


def mixed_script(text: Column) -> Column:
    """The language of a text with two scripts or more: most letters, ties to ru, then he; null if it isn't mixed."""

    def pick(n: dict[str, Column]) -> Column:
        kinds = sum(((n[k] > 0).cast("int") for k in ("latin", "cyrillic", "hebrew")), F.lit(0))
        most = F.greatest(n["latin"], n["cyrillic"], n["hebrew"])
        return F.when(kinds >= 2, F.when(n["cyrillic"] == most, "ru").when(n["hebrew"] == most, "he").otherwise("en"))

    return _once(text, pick)


def technical_kind(token: Column) -> Column:
    """What kind of technical token it is, or null: paths, UUIDs, versions, numbers with separators, file names."""
    name = F.regexp_extract(token, r"^[^/\\]+\.([\p{L}\p{N}]{1,8})$", 1)
    base = F.regexp_extract(token, r"^(.+)\.[^.]*$", 1)
    return (
        F.when(token.startswith("/"), "path")
        .when(token.rlike(r"^\p{L}:[\\/]"), "windows_path")
        .when(F.lower(token).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "uuid")
        .when(token.rlike(r"^[vV]?[0-9]+(\.[0-9]+){1,3}$"), "version")
        .when(token.rlike("^[0-9:+/%.,-]+$") & token.rlike("[0-9]") & token.rlike("[^0-9]"), "number")
        .when(F.lower(name).isin(*EXTENSIONS) & base.rlike(r"\p{L}"), "file")
    )


def word_in_script(word: Column, lang: str) -> Column:
    return word.rlike(f"^[{SCRIPTS[lang]}]+$")


def drop_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\p{S} \n\r\t]", "")


def has_garbage(text: Column) -> Column:
    """Control characters other than white space, DEL, or the not sign."""
    return text.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F¬]")
