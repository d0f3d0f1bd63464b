"""Text expressions that stay in the JVM, but for texts with rare characters or entities.

Such texts alone are handed to Python in Arrow batches (others travel as nulls), where the
standard library decodes every entity and folds every character.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented letters and what they fold to, characters that folding leaves, and the entities decoded in the JVM.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
UNFOLDED = "ß“”‘’–—•€«»¡¿"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
_RARE_ENTITY = r"&(?!(?:lt|gt|quot|#39|nbsp|amp);)(?:#|[A-Za-z])"
_RARE_CHARACTER, _CONTROL = rf"[^\x00-\x7F{ACCENTED}{UNFOLDED}]", r"[\x00-\x08\x0E-\x1F]"
# English stop words of the cleaning step, as published with a common toolkit.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just "
    "don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
# Stop words of the retrieval tokeniser.
SEARCH_STOP_WORDS = "a an and are as at be by for from has in is it its of on or that the to was were will with this these those we our their they which what how did does do".split()

#: What the cleaner makes of a byte: a letter in lower case, a blank, or nothing.
_BYTE = np.zeros(256, dtype=np.uint8)
_BYTE[list(b" \t\n\r")] = ord(" ")
for _c in range(ord("a"), ord("z") + 1):
    _BYTE[[_c, _c - 32]] = _c


@F.pandas_udf(T.StringType())
def _decoded(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else html.unescape(t).replace("\xa0", " "))


def unescape(x: Column) -> Column:
    """HTML entities as characters, a no-break space as a space; decoded once."""
    some = F.contains(x, F.lit("&"))
    return F.coalesce(_decoded(F.when(some & x.rlike(_RARE_ENTITY), x)), F.when(some, _common_entities(x)).otherwise(x))


def _common_entities(x: Column) -> Column:
    for k, v in ENTITIES.items():
        x = F.replace(x, F.lit(k), F.lit(v))
    return x


def collapse(x: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f\x0B]+", " "))


def fold(x: Column) -> Column:
    """Accents removed from Latin letters, without leaving the JVM."""
    return F.translate(x, ACCENTED, PLAIN)


def normalized(text: str) -> str:
    """One text as :func:`normalize` gives it."""
    flat = unicodedata.normalize("NFKD", html.unescape(re.sub(r"<[^>]+>", " ", text)))
    return re.sub(r"\s+", " ", "".join(c for c in flat if not unicodedata.combining(c))).lower()


@F.pandas_udf(T.StringType())
def _normalized(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else normalized(t))


def normalize(x: Column) -> Column:
    """Tags to spaces, entities decoded, compatibility-decomposed without combining marks, white space to single spaces, lower case; null is empty."""
    held = F.coalesce(x, F.lit(""))
    # each step only where the text has something for it; the conditions read the text as it is
    tags, entities, accents = F.contains(held, F.lit("<")), F.contains(held, F.lit("&")), F.octet_length(held) != F.length(held)
    plain = F.when(tags, F.regexp_replace(held, "<[^>]+>", " ")).otherwise(held)
    plain = F.when(entities, _common_entities(plain)).otherwise(plain)
    plain = F.when(accents, fold(plain)).otherwise(plain)
    plain = F.lower(F.regexp_replace(plain, r"[ \t\n\r\f\x0B]+", " "))
    return F.coalesce(_normalized(F.when((accents & held.rlike(_RARE_CHARACTER)) | held.rlike(_CONTROL) | (entities & held.rlike(_RARE_ENTITY)), held)), plain)


def slug(x: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")


# Endings of plural nouns and what they become.
NOUN_ENDINGS = (("ches", "ch"), ("shes", "sh"), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("men", "man"), ("ies", "y"), ("s", ""))


def lemma(word: str, lexicon: frozenset[str], exceptions: dict[str, str]) -> str:
    """The shortest form of a noun that the lexicon knows: an irregular one, itself, or without an ending."""
    if word in exceptions:
        return exceptions[word]
    forms = [word] if word in lexicon else []
    forms += [f for end, new in NOUN_ENDINGS if word.endswith(end) and not (end == "s" and word.endswith("ss")) and (f := word[: len(word) - len(end)] + new) in lexicon]
    return min(forms, key=len, default=word)


def lemmatise(words: Column, lexicon: frozenset[str], exceptions: dict[str, str] | None = None) -> Column:
    """Each word of an array as its lemma; the caller brings the lexicon, which is sent to the workers."""
    known, odd = lexicon, exceptions or {}

    @F.pandas_udf("array<string>")
    def each(x: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in seen:
                seen[w] = lemma(w, known, odd)
            return seen[w]

        return x.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return each(words)


def clean_words(x: Column) -> Column:
    """Words of the review cleaner: letters only, lower case, no stop words, over two letters."""
    letters = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", " "), r"[^a-zA-Z \t\n\r]+", "")
    return F.filter(F.split(F.lower(letters), r"[ \t\n\r]+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def clean_lists(texts: pa.Array) -> pa.Array:
    """:func:`clean_words` of an Arrow array of strings, for steps that run in a task anyway; patterns run only over texts with a ``<``."""
    held = pc.fill_null(texts, "")
    tagged = pc.match_substring(held, "<")
    if pc.any(tagged).as_py():
        held = pc.replace_with_mask(held, tagged, pc.replace_substring_regex(held.filter(tagged), "<[^>]*>", " "))
    held = held.cast(pa.large_string())
    ends = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, 8 * held.offset)
    raw = np.frombuffer(held.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    kept = _BYTE[raw] != 0
    char = _BYTE[raw[kept]]
    text_at = np.concatenate(([0], np.cumsum(kept)))[ends - ends[0]]  # where each text begins and ends in what is kept
    letter = char != ord(" ")
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = text_at[text_at < len(char)]
    first[inner] = letter[inner]
    begins = np.flatnonzero(first)
    of_letters = np.concatenate(([0], np.cumsum(letter)))
    bounds = pa.array(np.append(of_letters[begins], of_letters[-1]))
    words = pa.LargeStringArray.from_buffers(len(begins), bounds.buffers()[1], pa.py_buffer(char[letter].tobytes())).cast(pa.string())
    fit = pc.and_(pc.greater(pc.binary_length(words), 2), pc.invert(pc.is_in(words, value_set=pa.array(STOP_WORDS))))
    many = np.concatenate(([0], np.cumsum(fit.to_numpy(zero_copy_only=False))))[np.searchsorted(begins, text_at)]
    return pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), words.filter(fit))


def tokens(x: Column) -> Column:
    """Retrieval tokens ``[a-z0-9]+`` of the lower-cased text without stop words, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(SEARCH_STOP_WORDS))


def html_text(x: Column) -> Column:
    """Visible text of well-formed HTML: scripts, styles and comments out, tags to spaces."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<script.*?</script>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?is)<style.*?</style>", " "), r"(?s)<!--.*?-->", " ")
    return collapse(unescape(F.regexp_replace(x, "<[^>]+>", " ")))


def first_match(x: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that is found."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(x.rlike(pattern), label).otherwise(out)
    return out


def lookup(x: Column, exact: dict[str, str], contained: list[tuple[str, str]]) -> Column:
    """Exact dictionary hit, else the label of the first contained key, else null."""
    key = F.lower(F.trim(x))
    out = F.lit(None).cast("string")
    for part, label in reversed(contained):
        out = F.when(F.contains(key, F.lit(part)), label).otherwise(out)
    for whole, label in exact.items():
        out = F.when(key == whole, label).otherwise(out)
    return out


def least_years(x: Column, pattern: str) -> Column:
    """The smallest captured number in 1 to 20, null if none."""
    found = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda v: v.try_cast("int"))
    return F.array_min(F.filter(found, lambda v: (v > 0) & (v <= 20)))


def task_profile(x: Column, vocab: dict[str, list[str]], fallback: Column, least_chars: int = 80, least: int = 2, margin: int = 2) -> Column:
    """``struct(profile, counts, source)`` by how many patterns of each profile are found.

    Short texts use the fallback; no signal is none, under ``least`` weak, a tie or a lead
    below ``margin`` mixed, otherwise the leading profile.
    """
    src = F.when(F.length(x) >= least_chars, x).otherwise(fallback)
    counts = F.array(*[sum((src.rlike(p).cast("int") for p in ps), F.lit(0)) for ps in vocab.values()])
    names = F.array(*map(F.lit, vocab))

    def decide(c: Column) -> Column:
        best = F.array_sort(c, lambda a, b: b - a)
        top, second = best[0], best[1]
        return F.when(top == 0, "none").when(top < least, "weak").when(top - second < margin, "mixed").otherwise(F.element_at(names, F.array_position(c, top).cast("int")))

    return F.struct(F.transform(F.array(counts), decide)[0].alias("profile"), counts.alias("counts"), F.when(F.length(x) >= least_chars, "tasks").otherwise("description").alias("source"))
