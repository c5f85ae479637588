"""Text primitives as native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions import fixed_values as fv

_BLANKS = " " * len(fv.WHITESPACE_CHARS)
_BY_RARITY = "qzxjkvbpgwyfm.culdrhsnioate "  # of characters in prose; those left out count as rarer
_COMMON = frozenset("rhsnioate ")
_SEPARATOR = "\x1f"


def _rare_blanks() -> str:
    """Every whitespace character but blank and line break. Those beyond Latin-1 are asked for only inside their range."""
    rare = [c for c in fv.WHITESPACE_CHARS if c not in " \n"]
    low, high = [c for c in rare if c < "\u0100"], [c for c in rare if c >= "\u0100"]
    return f"[{''.join(low)}[{min(high)}-{max(high)}&&[{''.join(high)}]]]"


_RARE_BLANKS = _rare_blanks()


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words(col: Column) -> Column:
    """Whitespace-separated words; no empty entries.

    Mapping every kind of whitespace to a blank first allows a split at one character, which is several
    times faster than a split at a character class. Most texts have blanks and line breaks only.
    """
    plain = ~F.rlike(col, F.lit(_RARE_BLANKS))
    blanked = F.when(plain, F.replace(col, F.lit("\n"), F.lit(" "))).otherwise(F.translate(col, fv.WHITESPACE_CHARS, _BLANKS))
    return F.array_remove(F.split(blanked, " ", -1), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and wherever the result is repeated.

    The optimiser repeats an expression wherever a filter on it is pushed down; long nested ones outgrow
    generated code that way. As the argument of an array function they stay one expression.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    """Without whitespace of any kind at both ends."""
    return F.trim(col, F.lit(fv.WHITESPACE_CHARS))


def occurrences(col: Column, needle: str | Column) -> Column:
    """Non-overlapping occurrences of one substring.

    Byte lengths are exact for UTF-8 and cost nothing to read. The ``contains`` guard skips the
    replace for texts without the needle, which are most of them.
    """
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.when(F.contains(col, needle), _occurrences(col, needle)).otherwise(0)


def _occurrences(col: Column, needle: Column) -> Column:
    removed = F.octet_length(col) - F.octet_length(F.replace(col, needle, F.lit("")))
    return (removed / F.octet_length(needle)).cast("int")


def total_occurrences(col: Column, phrases: Sequence[str], near: Column | None = None) -> Column:
    """Sum of occurrences over all phrases; one fold over a literal array keeps the plan small.

    ``near`` is ``around_phrases(col, ...)`` of these phrases and any others: only what it holds is counted in the text.
    """
    if near is None:
        return F.aggregate(_literals(phrases), F.lit(0), lambda acc, p: acc + occurrences(col, p))
    present = F.filter(_literals(phrases), lambda p: F.contains(near, p))
    return F.aggregate(present, F.lit(0), lambda acc, p: acc + _occurrences(col, p))


def around_phrases(col: Column, phrases: Sequence[str], most_bytes: int = 1_000_000) -> Column:
    """The pieces of the text around the phrases: a short text that holds every one of ``phrases`` that the text holds.

    One scan for all of them, where a search for each takes a hundred. A phrase is looked for at its rarest character,
    so most characters are passed by one test. The piece reaches back from the phrase's end twice as far as the longest
    phrase, so it holds the others at this character, too. Longer texts stay whole, as pieces may add up.
    """
    phrases = sorted({p for p in phrases if p})
    if not phrases:
        return F.lit("")
    apart = [p for p in phrases if _COMMON.issuperset(p)]  # their rarest character would stop the scan too often
    scanned = [p for p in phrases if p not in apart]
    if len(apart) > 3 or not scanned:
        apart, scanned = [], phrases
    pieces = F.regexp_extract_all(col, F.lit(_phrase_ends(scanned, 2 * max(map(len, phrases)))), F.lit(1))
    if apart:
        pieces = F.concat(pieces, F.array(*[F.when(F.contains(col, F.lit(p)), F.lit(p)) for p in apart]))
    return F.when(F.octet_length(col) <= most_bytes, F.array_join(pieces, _SEPARATOR)).otherwise(col)


def _phrase_ends(phrases: Sequence[str], back: int, together: int = 8) -> str:
    """A pattern that finds the rarest character of a phrase; its group is the text up to the end of that phrase.

    ``back`` is twice the longest length: lengths are characters, but the search back goes by UTF-16 units.
    """
    rarest: dict[str, list[tuple[str, str]]] = {}
    for phrase in phrases:
        at = min(range(len(phrase)), key=lambda i: _BY_RARITY.find(phrase[i]))
        rarest.setdefault(phrase[at], []).append((phrase[at + 1:], phrase))
    common_first = sorted(rarest, key=_BY_RARITY.find, reverse=True)
    tests = []
    for last in (False, True):  # characters that go on in every phrase are tested together with the next one
        chars = [c for c in common_first if any(not end for end, _ in rarest[c]) is last]
        for group in (chars[i:i + together] for i in range(0, len(chars), together)):
            after = "" if last else _any(sorted({end[0] for c in group for end, _ in rarest[c]}))
            tests.append(f"(?={_any(group)}{after})(?:{'|'.join(_quoted(c) + _rest(rarest[c]) for c in group)})")
    piece = f"^.{{0,{back - 1}}}?|.{{{back},{2 * back}}}?"
    return f"(?s)(?={_any(common_first)})(?=(?:{'|'.join(tests)})(?<=({piece})))."


def _rest(ends: Sequence[tuple[str, str]]) -> str:
    """One of the ends, the longest that fits, if the whole phrase stands before its last character."""
    longer = [_quoted(c) + _rest([(end[1:], phrase) for end, phrase in ends if end[:1] == c])
              for c in sorted({end[0] for end, _ in ends if end})]
    done = [f"(?<={''.join(map(_quoted, phrase))})" for end, phrase in ends if not end]
    return f"(?:{'|'.join(longer + done)})"


def _any(chars: Sequence[str]) -> str:
    return f"[{''.join(map(_quoted, chars))}]"


def _quoted(char: str) -> str:
    return char if char.isalnum() or char == " " else "\\" + char


def phrases_present(col: Column, phrases: Sequence[str]) -> Column:
    """Number of distinct phrases that occur."""
    return F.aggregate(_literals(phrases), F.lit(0), lambda acc, p: acc + F.contains(col, p).cast("int"))


def matches(col: Column, pattern: str, needle: str | None = None) -> Column:
    """Number of non-empty regex matches; ``needle`` is a substring every match must contain.

    Counted as gaps of a split: linear in the text, where counting extracted matches copies the whole
    text once per match.
    """
    count = F.size(F.split(col, pattern, -1)) - 1
    if needle is None:
        return count
    return F.when(F.contains(col, F.lit(needle)), count).otherwise(0)


def ends_with_any(col: Column, suffixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for suffix in suffixes:
        found = found | F.endswith(col, F.lit(suffix))
    return found


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 when whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def word_statistics(word_list: Column) -> Column:
    """struct(distinct, repeated, clogc) from a *sorted* word array.

    Equal words are neighbours after sorting. A word is marked 1 if the next one equals it, else 0, so in the joined marks
    every run ends with a 0 and a run of c words gives c - 1 ones before it. No shuffle is needed, and the whole text is
    used whatever its length. repeated: distinct words with more than three occurrences; clogc: sum of c * log2(c) over
    distinct words. Only runs of two or more are added up.
    """
    marks = F.zip_with(word_list, F.slice(word_list, F.lit(2), F.size(word_list)),
                       lambda word, after: F.when(word == after, "1").otherwise("0"))

    def runs(ones: Column) -> Column:
        return let(F.array_remove(ones, ""), lambda many: F.struct(
            (F.size(ones) - 1).alias("distinct"),
            F.size(F.filter(many, lambda one: F.length(one) >= 3)).alias("repeated"),
            F.aggregate(F.transform(many, lambda one: F.length(one) + 1), F.lit(0.0),
                        lambda acc, c: acc + c * F.log2(c)).alias("clogc")))

    return let(F.split(F.array_join(marks, ""), "0", -1), runs)


def _literals(values: Sequence[str]) -> Column:
    """Constant string array, from one literal: the optimiser folds the split away."""
    return F.split(F.lit(_SEPARATOR.join(values)), _SEPARATOR, -1)
