"""Text views as Column expressions: Unicode folding, detection view, campaign text, simhash.

Views stay in the JVM. Spark has no Unicode normaliser, so the folding tables are derived
from Python's ``unicodedata`` once, on the driver, and become the two literals of ``translate``.
Pure ASCII text skips them. Only the bits of a fingerprint are counted over Arrow batches: lambdas over
arrays are interpreted, and 22 passes over a text's words took most of the time of every query with fingerprints.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from vigia import fixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PART = 1 << 16  # hashes whose bits are spread out at once

_HANGUL_SYLLABLES = range(0xAC00, 0xD7A4)
_SURROGATES = range(0xD800, 0xE000)
_CODE_POINTS = (range(0x80, 0x30000), range(0xE0100, 0xE01F0))


def _zero_width(code: int) -> bool:
    return any(first <= code <= last for first, last in fixed.ZERO_WIDTH_RANGES)


@lru_cache(maxsize=None)
def fold_tables(kind: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, replacements, expansions) for ``detection``, ``token`` or ``campaign`` text.

    Characters past the end of the replacements are deleted. Expansions turn one character into
    several; only those that yield an ASCII letter, digit or dot can matter to a pattern.
    """
    confusables = str.maketrans(fixed.CONFUSABLE_FROM, fixed.CONFUSABLE_TO)
    blanks = "" if kind == "token" else _RARE_BLANKS
    singles, deletes, expansions = [], [], []
    for block in _CODE_POINTS:
        for code in block:
            if code in _HANGUL_SYLLABLES or code in _SURROGATES:
                continue
            char = chr(code)
            if kind == "campaign":
                kept = [c for c in unicodedata.normalize("NFKD", char).casefold()
                        if not unicodedata.combining(c)]
            else:
                composed = unicodedata.normalize("NFKC", char)
                if kind == "token":
                    composed = composed.casefold()
                composed = composed.translate(confusables)
                kept = [c for c in unicodedata.normalize("NFD", composed)
                        if unicodedata.category(c) != "Mn"]
                if kind == "detection":
                    kept = [c for c in kept if not _zero_width(ord(c))]
            folded = " " if char in blanks else "".join(kept)
            if folded == char:
                continue
            if not folded:
                deletes.append(char)
            elif len(folded) == 1:
                singles.append((char, folded))
            elif any(c.isascii() and (c.isalnum() or c == ".") for c in folded):
                expansions.append((char, folded))
    return (
        "".join(c for c, _ in singles) + "".join(deletes),
        "".join(f for _, f in singles),
        tuple(expansions),
    )


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pin(value: Column) -> Column:
    """The same value, but computed where it is written. Filters and generators above would
    otherwise be pushed below the projection together with a copy of the whole expression; the
    optimiser never moves a random number, so one is consulted (and ignored). It is negated, because the
    optimiser knows the range of a plain one, takes the test out and the value is not held."""
    return F.when(-F.rand(0) <= 0, value)


# Expansions seen in everyday text are replaced directly, the rest by a per-character lookup.
_EVERYDAY = "…™½¼¾ﬁﬂ№ß"


# Java looks single letters of a class up in one table, but asks every range in turn: classes that are tested at
# each character list their letters.
_LETTERS = string.ascii_uppercase + string.ascii_lowercase
WORD = _LETTERS + string.digits + "_"


def quick(pattern: str, flags: str = "") -> str:
    r"""The same pattern behind a look at its first letter.

    Java tests a Unicode ``\b`` slowly and at every character. The alternatives of a word pattern
    ``\b(?:one|two)`` begin with few letters, and a plain character class is tested first, fast.
    """
    if not pattern.startswith(r"\b(?:"):
        raise ValueError(pattern)
    depth, firsts, at_start, i = 0, set(), True, len(r"\b(?:")
    while depth >= 0:
        char = pattern[i]
        if at_start:
            if char == "[":
                firsts.update(pattern[i + 1:pattern.index("]", i)])
            elif pattern.startswith(r"\d", i):
                firsts.update("0123456789")
            else:
                firsts.add(char)
            at_start = False
        if char == "\\":
            i += 1
        elif char == "[":
            i = pattern.index("]", i)
        elif char == "(":
            depth += 1
        elif char == ")":
            depth -= 1
        elif char == "|" and depth == 0:
            at_start = True
        i += 1
    return f"(?=[{_either_case(firsts, flags)}]){flags}{pattern}"


def _either_case(firsts, flags: str) -> str:
    letters = {c for f in firsts for c in (f.lower(), f.upper())} if "i" in flags else set(firsts)
    if "i" in flags and letters & set("sk"):
        letters |= set("ſK")  # fold to s and k
    return "".join(sorted(letters))


def _alternatives(pattern: str) -> tuple[list[str], str]:
    r"""Alternatives of a word pattern ``\b(?:one|two)`` and what follows their group."""
    found, start, depth, i = [], len(r"\b(?:"), 0, len(r"\b(?:")
    while depth >= 0:
        char = pattern[i]
        if char == "\\":
            i += 1
        elif char == "[":
            i = pattern.index("]", i)
        elif char == "(":
            depth += 1
        elif char == ")":
            depth -= 1
        if (char == "|" and depth == 0) or depth < 0:
            found.append(pattern[start:i])
            start = i + 1
        i += 1
    return found, pattern[i:]


def says(text: Column, pattern: str, flags: str) -> Column:
    r"""Whether a word pattern ``\b(?:one|two)`` occurs.

    Java's Unicode ``\b`` and its walk through the alternatives are slow, so both run only behind a character that is
    no ASCII word character (the blank put in front is the first one), and alternatives with the same first letter
    are behind one test of it.
    """
    words, rest = _alternatives(pattern)
    # a boundary before a sign wants a word character in front
    if not all(word[0] in WORD and word[1:2] not in ("?", "*", "+", "{") for word in words):
        return text.rlike(quick(pattern, flags))
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(word[1:])
    branches = "|".join(first + (tails[0] if len(tails) == 1 else f"(?:{'|'.join(tails)})") for first, tails in groups.items())
    # \b is asked once more in Java's way: characters beyond ASCII may be word characters
    return F.concat(F.lit(" "), text).rlike(
        rf"[^{WORD}](?=[{_either_case(groups, flags)}]){flags}\b(?:{branches}){rest}")


def literal_branches(words: list[str], quote) -> str:
    """Alternation of literal words, longest first, that takes the same word as their plain list: words are parted by
    their next character, of which only one can be there."""
    groups: dict[str, list[str]] = {}
    for word in dict.fromkeys(words):
        groups.setdefault(word[:1], []).append(word[1:])
    ended = "" in groups
    branches = [quote(first) + (quote(tails[0]) if len(tails) == 1 else f"(?:{literal_branches(tails, quote)})")
                for first, tails in groups.items() if first]
    return "|".join(branches + [""] * ended)  # sorted by length, so an ended word is the last choice


def _ranges(chars) -> str:
    codes, spans = sorted(ord(c) for c in chars), []
    for code in codes:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)


def _far(chars) -> str:
    """Class of characters beyond ASCII; one comparison rules the letters before the first of them out."""
    codes = sorted(map(ord, chars))
    return rf"[\x{{{codes[0]:X}}}-\x{{{codes[-1]:X}}}&&[{_ranges(map(chr, codes))}]]"


def fold(text: Column, kind: str) -> Column:
    source, target, expansions = fold_tables(kind)
    everyday = [(c, r) for c, r in expansions if c in _EVERYDAY]
    rare = [(c, r) for c, r in expansions if c not in _EVERYDAY]
    # one packed string, searched only for the rare characters themselves
    packed = F.lit("\x01" + "\x01".join(f"{c}\x02{r}" for c, r in rare) + "\x01")
    any_rare = _far(c for c, _ in rare)

    def spell(char: Column) -> Column:
        behind = F.call_function(
            "substring_index", packed, F.concat(F.lit("\x01"), char, F.lit("\x02")), F.lit(-1))
        return F.when(char.rlike(any_rare), F.substring_index(behind, "\x01", 1)).otherwise(char)

    def spell_rare(view: Column) -> Column:
        spelled = F.array_join(F.transform(F.split(view, ""), spell), "")
        return F.when(view.rlike(any_rare), spelled).otherwise(view)

    def folded(raw: Column) -> Column:
        view = F.translate(raw, source, target)
        for char, replacement in everyday:
            view = F.replace(view, F.lit(char), F.lit(replacement))
        return F.when(F.octet_length(raw) == F.char_length(raw), raw) \
            .otherwise(let(view, spell_rare))

    return let(text, folded)


def casefold(text: Column) -> Column:
    """Lower-case with the two folds that ``lower`` lacks and that occur in practice."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def regexp_map(text: Column, pattern: str, replace) -> Column:
    """Replace every match of ``pattern`` by ``replace(match)``, an arbitrary Column function."""
    def rebuild(value: Column) -> Column:
        joined = F.array_join(
            F.zip_with(
                F.split(value, pattern, -1),
                F.regexp_extract_all(value, F.lit(pattern), F.lit(0)),
                lambda part, match: F.concat(part, F.coalesce(replace(match), F.lit(""))),
            ),
            "",
        )
        return F.when(value.rlike(pattern), joined).otherwise(value)

    return let(text, rebuild)


def one_blank(text: Column) -> Column:
    """Runs of blanks as one plain space, for text whose blanks beyond ASCII ``fold`` has made plain."""
    def plain(view: Column, blank: str) -> Column:
        return let(view, lambda v: F.when(v.contains(blank), F.replace(v, F.lit(blank), F.lit(" "))).otherwise(v))

    return let(reduce(plain, _ASCII_BLANKS, text), lambda v: F.when(
        v.contains("  "), F.regexp_replace(v, " {2,}", " ")).otherwise(v))


# Single letters with one blank between them. Of fixed length, so Java repeats the group in a loop: a run may
# have any number of letters, and blanks are made one before the test.
_SPACED_RUN = r"(?=[a-zA-Z] [a-zA-Z] [a-zA-Z])(?U)(?<!\w)(?:[a-zA-Z] ){2,}[a-zA-Z](?!\w)"
_SPACED_LETTERS = r"(?iU)(?<!\w)(?:[a-záéíóúüñ] ){2}[a-záéíóúüñ](?!\w)"
# ASCII-only test that every such run passes
_MAYBE_SPACED = r"(?:^|\W)(?:[A-Za-z]|[^\x00-\x7F])\s+(?:[A-Za-z]|[^\x00-\x7F])\s+(?:[A-Za-z]|[^\x00-\x7F])(?:\W|$)"
# Shorter tests that all of these pass as well, in text with single blanks and in any text; most texts fail them
_SPACED_END = rf" [{_LETTERS}] [{_LETTERS}](?![{WORD}])"
_ANY_BLANK, _ANY_LETTER = r"[\s\x1C\x1D\x1E\x1F]", r"[A-Za-z\x{80}-\x{10FFFF}]"
_ANY_SPACED_END = (rf"(?U){_ANY_BLANK}(?<={_ANY_LETTER}{_ANY_BLANK})(?<![A-Za-z0-9_]{_ANY_LETTER}{_ANY_BLANK})"
                   rf"{_ANY_BLANK}*{_ANY_LETTER}{_ANY_BLANK}+{_ANY_LETTER}(?![A-Za-z0-9_])")
_SPLIT_APP_NAME = "(?=[aAtTrR])" + fixed.SPLIT_APP_NAME
_TOKEN_EDGE = r"(?U)(?<=[^\w-])|(?=[^\w-])"
# Whole tokens of ASCII letters, digits, _ and - with a letter and a leet digit, and the character before each
_LEET_WORD = (rf"[^{WORD}-](?=[{_LETTERS}2689_-]*[013457])(?=[0123456789_-]*[{_LETTERS}])(?U)(?<![\w-])"
              rf"[{WORD}-]++(?![\w-])")
# Stretches without ASCII blanks or punctuation in which a leet digit occurs, and the character before each
_PARTING = "".join(rf"\x{c:02X}" for c in range(128) if chr(c) not in WORD + "-")
_LEET_DIGITS = "".join(rf"\x{ord(c):02X}" for c in fixed.LEET_FROM)
_LEET_STRETCH = rf"[{_PARTING}][^{_PARTING}{_LEET_DIGITS}]*+[{_LEET_DIGITS}][^{_PARTING}]*+"


def _leet_beside(letters: str) -> str:
    """A leet digit beside one of the letters, or only digits away from it. Digits are rare and looked for first."""
    return rf"(?=[0123456789])(?:(?<=[{letters}])[0123456789]*[013457]|[013457][0123456789]*[{letters}])"


_LEET_TOKEN = _leet_beside(_LETTERS + "_-")


# Runs of blanks but for one plain space, which stays as it is.
_ODD_BLANK = r"\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ASCII_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_RARE_BLANKS = "\x85\u1680\u2028\u2029"  # blanks beyond ASCII that no normal form makes plain
_BLANKS = f"[{_ODD_BLANK}][ {_ODD_BLANK}]*| [ {_ODD_BLANK}]+"


def _leet_tokens(text: Column) -> Column:
    def plain(token: Column) -> Column:
        ours = token.rlike("^[A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*$")
        return F.when(ours, F.translate(token, fixed.LEET_FROM, fixed.LEET_TO)).otherwise(token)

    def spell(value: Column) -> Column:
        # beyond the basic plane the token edges also part the two halves of a character
        spelled = F.array_join(F.transform(F.split(value, _TOKEN_EDGE), plain), "")
        words = F.substring(regexp_map(F.concat(F.lit(" "), value), _LEET_WORD, lambda word: F.translate(
            word, fixed.LEET_FROM, fixed.LEET_TO)), 2, 2**31 - 1)
        beyond = (F.octet_length(value) != F.char_length(value)) & value.rlike(r"[\x{10000}-\x{10FFFF}]")
        return F.when(value.rlike(_LEET_TOKEN), F.when(beyond, spelled).otherwise(words)).otherwise(value)

    return let(text, spell)


def detection_view(text: Column) -> Column:
    """Text as a reader would understand it, whatever tricks hide the words."""
    view = one_blank(fold(text, "detection"))
    view = let(view, lambda v: F.when(v.rlike(_SPACED_END), regexp_map(
        v, _SPACED_RUN, lambda run: F.replace(run, F.lit(" "), F.lit("")))).otherwise(v))
    view = _leet_tokens(view)
    view = F.regexp_replace(view, _SPLIT_APP_NAME, "$1$2")
    return casefold(F.trim(view))


def obfuscations(text: Column) -> Column:
    """Labels of the hiding techniques used, in a fixed order."""
    labels = fixed.OBFUSCATION_LABELS
    invisible = _far(chr(code) for a, b in fixed.ZERO_WIDTH_RANGES for code in range(a, b + 1))
    stretches = F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(_LEET_STRETCH), F.lit(0))

    def tokens(stretch: Column) -> Column:
        return F.regexp_extract_all(stretch, F.lit(r"(?iU)(?<!\w)[a-záéíóúüñ0-9_-]+(?!\w)"), F.lit(0))

    def hides_term(token: Column) -> Column:
        spelled = casefold(F.translate(token, fixed.LEET_FROM, fixed.LEET_TO))
        return (
            token.rlike("[013457]") & token.rlike("(?i)[a-záéíóúüñ]")
            & spelled.rlike("|".join(fixed.SENSITIVE_LEET_TERMS))
        )

    mixed = _leet_beside(_LETTERS + "áéíóúüñÁÉÍÓÚÜÑ_-")
    leet = F.when(text.rlike(mixed), F.exists(
        stretches, lambda stretch: F.exists(tokens(stretch), hides_term))).otherwise(F.lit(False))
    foreign = F.octet_length(text) != F.char_length(text)

    def spaced(plain: Column) -> Column:
        return F.when(foreign, plain.rlike(_MAYBE_SPACED)).otherwise(text.rlike(_MAYBE_SPACED)) & plain.rlike(_SPACED_LETTERS)

    # a branch, not "and": what two tests behind an "and" share would be worked out for every text
    spaced_letters = F.when(text.rlike(_ANY_SPACED_END), let(F.regexp_replace(text, _BLANKS, " "), spaced))
    return F.array_compact(F.array(
        F.when(foreign & text.rlike(invisible), labels[0]),
        F.when(foreign & text.rlike(_far(fixed.CONFUSABLE_FROM)), labels[1]),
        F.when(spaced_letters, labels[2]),
        F.when(text.rlike(_SPLIT_APP_NAME), labels[3]),
        F.when(leet, labels[4]),
    ))


def token(text: Column) -> Column:
    """Bare name used to compare brands and hosts: letters a-z and digits only."""
    return F.regexp_replace(casefold(fold(text, "token")), "[^a-z0-9]", "")


def token_literal(value: str) -> str:
    """``token`` for a driver-side dimension value."""
    confusables = str.maketrans(fixed.CONFUSABLE_FROM, fixed.CONFUSABLE_TO)
    folded = unicodedata.normalize("NFKC", value).casefold().translate(confusables)
    folded = unicodedata.normalize("NFD", folded)
    return "".join(c for c in folded if c.isascii() and c.isalnum())


def words_literal(value: str) -> str:
    """Folded alias of a driver-side dimension value (keeps blanks and dots)."""
    confusables = str.maketrans(fixed.CONFUSABLE_FROM, fixed.CONFUSABLE_TO)
    folded = unicodedata.normalize("NFKC", value).casefold().translate(confusables)
    return "".join(
        c for c in unicodedata.normalize("NFD", folded) if unicodedata.category(c) != "Mn"
    )


# --- fingerprints ---------------------------------------------------------------------------

def campaign_text(text: Column) -> Column:
    """Text with links and numbers neutralised, so that variants of one template agree."""
    view = casefold(fold(text, "campaign"))
    view = F.regexp_replace(view, r"(?=[hw])(?:https?://|www\.)(?U:\S+)", " URL ")
    view = F.regexp_replace(view, r"\p{Nd}+", " N ")
    return F.trim(one_blank(view))


def token_hash(word: Column) -> Column:
    """First 64 bits of md5 as a signed long."""
    return F.conv(F.substring(F.md5(word), 1, 16), 16, -10).cast("long")


def _majority(hashes: pa.Array) -> pa.Array:
    """Majority of every bit over the hashes of each row (ties set it); zero for none and for null."""
    sizes = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bits = hashes.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
    out, ends = np.zeros((len(sizes), 8), np.uint8), np.cumsum(sizes)
    for i in np.flatnonzero(sizes):
        first, last = ends[i] - sizes[i], ends[i]
        ones = sum(np.unpackbits(bits[k:min(k + _PART, last)], axis=1).sum(axis=0, dtype=np.int64)
                   for k in range(first, last, _PART))
        out[i] = np.packbits(2 * ones >= sizes[i])
    return pa.array(out.view(">i8").reshape(-1).astype(np.int64))


def simhash(text: Column) -> Column:
    words = F.regexp_extract_all(campaign_text(text), F.lit("[a-z]{2,}|URL|N"), F.lit(0))
    # like ``pin``: no filter on the result moves below the projection with a second run of all this
    return F.arrow_udf(_majority, "long").asNondeterministic()(F.transform(words, token_hash))


def bands(fingerprint: Column, count: int = 4) -> Column:
    """Equal-width slices of the fingerprint, lowest bits first."""
    width = 64 // count
    mask = F.lit((1 << width) - 1)
    return F.array(*[
        F.shiftrightunsigned(fingerprint, i * width).bitwiseAND(mask).cast("int")
        for i in range(count)
    ])


def similarity(left: Column, right: Column) -> Column:
    return F.lit(1.0) - F.bit_count(left.bitwiseXOR(right)) / F.lit(64.0)
