"""English stemmer after the published Porter2 description: in Python, and as SQL to compare it with."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_DONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, start: int) -> int:
    m = re.search(r"[aeiouy][^aeiouy]", word[start:])
    return start + m.end() if m else len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are returned as they are."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.replace("’", "'").lstrip("'")
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _DONE:
        return w
    # past and progressive forms
    if w.endswith(("eed", "eedly")):
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if re.search("[aeiouy]", w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif _short_end(w) and r1 >= len(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for end, new in _STEP2.items():
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
                w = w[: -len(end)] + new
            break
    for end, new in _STEP3.items():
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(1 << 20)
def cached_stem(word: str) -> str:
    """stem(), kept for the commonest words of a worker."""
    return stem(word)


def _cut(n: int, new: str = "") -> str:
    return f"left(w, length(w) - {n})" + (f" || '{new}'" if new else "")


def _matches(x: str, pattern: str) -> str:
    return f"regexp_extract({x}, '{pattern}', 0) <> ''"


def _short(x: str) -> str:
    """Whether x ends in a short syllable."""
    return f"(length({x}) = 2 AND {_matches(x, '^[aeiouy][^aeiouy]$')} OR length({x}) > 2 AND {_matches(x, '[^aeiouy][aeiouy][^aeiouywxY]$')})"


def _suffixes(rules: dict[str, str], region: dict[str, str], extra: dict[str, str]) -> str:
    """CASE over suffixes: the first that fits decides, and is replaced if it lies in its region."""
    out = ""
    for end, new in rules.items():
        test = f"length(w) - {len(end)} >= {region.get(end, region[''])}" + (f" AND substr(w, length(w) - {len(end)}, 1) IN ({extra[end]})" if end in extra else "")
        out += f" WHEN w LIKE '%{end}' THEN CASE WHEN {test} THEN {_cut(len(end), new)} ELSE w END"
    return f"CASE WHEN done THEN w{out} ELSE w END"


def steps(word: str) -> list[dict[str, str]]:
    """The stemmer as successive SQL projections over columns w, r1, r2, e, done, cut; the last w is the stem."""
    region = lambda frm: f"CASE WHEN {_matches(f'substr(w, {frm} + 1)', '^.*?[aeiouy][^aeiouy]')} THEN {frm} + length(regexp_extract(substr(w, {frm} + 1), '^.*?[aeiouy][^aeiouy]', 0)) ELSE length(w) END"
    whole = "CASE " + " ".join(f"WHEN {word} = '{k}' THEN '{v}'" for k, v in _WHOLE.items()) + f" WHEN length({word}) <= 2 THEN {word} END"
    rest = "left(w, length(w) - length(e))"
    vowel = lambda x: _matches(x, "[aeiouy]")
    ends = lambda *xs: " OR ".join(f"w LIKE '%{x}'" for x in xs)
    quoted = lambda s: ", ".join(f"'{c}'" for c in s)
    return [
        {"fixed": whole, "w": f"regexp_replace(replace({word}, '’', chr(39)), '^' || chr(39) || '+', '')"},
        {"w": r"regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g')"},
        {"r1": f"CASE WHEN w LIKE 'gener%' THEN 5 WHEN w LIKE 'commun%' THEN 6 WHEN w LIKE 'arsen%' THEN 5 ELSE {region(0)} END"},
        {"r2": region("r1")},
        {"w": "CASE WHEN right(w, 3) = chr(39) || 's' || chr(39) THEN " + _cut(3) + " WHEN right(w, 2) = chr(39) || 's' THEN " + _cut(2) + " WHEN right(w, 1) = chr(39) THEN " + _cut(1) + " ELSE w END"},
        {"w": f"CASE WHEN w LIKE '%sses' THEN {_cut(2)} WHEN {ends('ied', 'ies')} THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END WHEN w LIKE '%s' AND NOT ({ends('us', 'ss')}) AND {vowel(_cut(2))} THEN {_cut(1)} ELSE w END"},
        {"done": f"w IN ({quoted(sorted(_DONE))})", "e": "CASE " + " ".join(f"WHEN w LIKE '%{x}' THEN '{x}'" for x in ("eedly", "eed", "ingly", "edly", "ing", "ed")) + " ELSE '' END"},
        {"cut": f"NOT done AND e IN ('ingly', 'edly', 'ing', 'ed') AND {vowel(rest)}"},
        {"w": f"CASE WHEN done THEN w WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(w) - length(e) >= r1 THEN {rest} || 'ee' ELSE w END WHEN cut THEN {rest} ELSE w END"},
        {"w": f"CASE WHEN NOT cut THEN w WHEN {ends('at', 'bl', 'iz')} THEN w || 'e' WHEN {ends(*_DOUBLES)} THEN {_cut(1)} WHEN {_short('w')} AND r1 >= length(w) THEN w || 'e' ELSE w END"},
        {"w": f"CASE WHEN NOT done AND length(w) > 2 AND right(w, 1) IN ('y', 'Y') AND substr(w, length(w) - 1, 1) NOT IN ({quoted(_VOWELS)}) THEN {_cut(1, 'i')} ELSE w END"},
        {"w": _suffixes(_STEP2, {"": "r1"}, {"ogi": "'l'", "li": quoted("cdeghkmnrt")})},
        {"w": _suffixes(_STEP3, {"": "r1", "ative": "r2"}, {})},
        {"w": _suffixes(dict.fromkeys(_STEP4, ""), {"": "r2"}, {"ion": "'s', 't'"})},
        {"w": f"CASE WHEN done THEN w WHEN w LIKE '%e' THEN CASE WHEN length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {_short(_cut(1))}) THEN {_cut(1)} ELSE w END WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN {_cut(1)} ELSE w END"},
        {"w": "coalesce(fixed, replace(w, 'Y', 'y'))"},
    ]


def stem_sql(source: str, word: str) -> str:
    """CTEs st0 ... that take a relation with a column of words; the last, stems(word, stem), has a row per distinct word."""
    out, held = f"st0 AS (SELECT DISTINCT {word} AS word FROM {source})", []
    for k, step in enumerate(steps("word")):
        held = [*(c for c in held if c not in step), *step]
        out += f", st{k + 1} AS (SELECT word, " + ", ".join(f"{step[c]} AS {c}" if c in step else c for c in held) + f" FROM st{k})"
    return out + f", stems AS MATERIALIZED (SELECT word, w AS stem FROM st{len(steps('word'))})"
