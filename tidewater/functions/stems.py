"""English stems (the public Porter2 rules) as a few steps of SQL expressions.

The steps are written once and run on Spark columns as well as in other SQL engines. A
step looks at the longest of its endings that a word has, and changes the word only if
that ending lies in the right region: R1 starts after the first consonant that follows
a vowel, R2 is the R1 of R1. ``r1`` and ``r2`` count the letters before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of the rules: endings and what they become
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
    "ative": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive",
    "ize", "ion",
)
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LONG_STARTS = ("gener", "commun", "arsen")  # R1 starts after these
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")  # after the plural is gone

_REGION = "^.*?[aeiouy][^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _ending(endings: Sequence[str]) -> str:
    """The longest of the endings that ``w`` has, or an empty text: what starts first is longest."""
    return f"regexp_extract(w, '({'|'.join(sorted(endings, key=len, reverse=True))})$', 1)"


def _cut(n: int | str) -> str:
    return f"substr(w, 1, length(w) - {n})"


def _case(pairs: Sequence[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"


def _mapped(endings: dict[str, str], refused: str) -> str:
    """``w`` with its ending ``s`` replaced, where that is in R1 and not refused."""
    new = _case([(f"s = '{a}'", f"'{b}'") for a, b in endings.items()], "''")
    return f"CASE WHEN s = '' OR length(w) - length(s) < r1 OR {refused} THEN w ELSE concat({_cut('length(s)')}, {new}) END"


def steps(matches: str, replaced: str) -> list[dict[str, str]]:
    """Columns to set from ``word``, step after step; ``stem`` is set by the last.

    ``matches`` and ``replaced`` say how an engine spells a regular expression test of
    ``{0}`` against ``{1}`` and the replacement of all ``{1}`` by ``{2}`` (group 1: ``{{1}}``).
    """
    like = lambda x, pattern: matches.format(x, f"'{pattern}'")
    start = f"regexp_extract(w, '^({'|'.join(LONG_STARTS)})', 1)"
    region = lambda x: f"regexp_extract({x}, '({_REGION})', 1)"
    plural = _case(
        [
            ("s = 'sses'", _cut(2)),
            ("s IN ('ied', 'ies')", f"CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END"),
            (f"s = 's' AND {like(_cut(2), '[aeiouy]')}", _cut(1)),
        ],
        "w",
    )
    without = _case(
        [
            ("s IN ('eed', 'eedly')", f"CASE WHEN length(w) - length(s) >= r1 THEN concat({_cut('length(s)')}, 'ee') ELSE w END"),
            (f"s <> '' AND {like(_cut('length(s)'), '[aeiouy]')}", _cut("length(s)")),
        ],
        "w",
    )
    mended = _case(
        [
            (f"NOT shorter OR s IN ('', 'eed', 'eedly')", "w"),
            (like("w", "(at|bl|iz)$"), "concat(w, 'e')"),
            (like("w", f"({'|'.join(DOUBLES)})$"), _cut(1)),
            (f"length(w) <= r1 AND {like('w', _SHORT)}", "concat(w, 'e')"),
        ],
        "w",
    )
    last_e = (
        f"substr(w, length(w), 1) = 'e' AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {like(_cut(1), _SHORT)})"
    )
    last_l = f"{like('w', 'll$')} AND length(w) - 1 >= r2"
    return [
        {"w": replaced.format(replaced.format("word", "'^y'", "'Y'"), "'([aeiouy])y'", "'{1}Y'")},
        {"r1": f"CASE WHEN {start} <> '' THEN length({start}) WHEN {region('w')} <> '' THEN length({region('w')}) ELSE length(w) END"},
        {
            "r2": f"CASE WHEN {region('substr(w, r1 + 1)')} <> '' THEN r1 + length({region('substr(w, r1 + 1)')}) ELSE length(w) END",
            "s": _ending(("sses", "ied", "ies", "us", "ss", "s")),
        },
        {"w": plural},
        {"s": _ending(("eed", "eedly", "ed", "edly", "ing", "ingly")), "kept": f"w IN ({', '.join(map(repr, KEPT))})", "before": "w"},
        {"w": without},
        {"shorter": "length(w) < length(before)"},
        {"w": mended},
        {"w": _case([(like("w", "^.+[^aeiouy][yY]$"), f"concat({_cut(1)}, 'i')")], "w")},
        {"s": _ending(tuple(STEP_2))},
        {"w": _mapped(STEP_2, f"s = 'ogi' AND NOT {like('w', 'logi$')} OR s = 'li' AND NOT {like('w', '[cdeghkmnrt]li$')}")},
        {"s": _ending(tuple(STEP_3))},
        {"w": _mapped(STEP_3, "s = 'ative' AND length(w) - length(s) < r2")},
        {"s": _ending(STEP_4)},
        {
            "w": f"CASE WHEN s = '' OR length(w) - length(s) < r2 OR s = 'ion' AND NOT {like('w', '[st]ion$')} "
            f"THEN w ELSE {_cut('length(s)')} END"
        },
        {"w": _case([(last_e, _cut(1)), (last_l, _cut(1))], "w")},
        {
            "stem": _case(
                [(f"word = '{a}'", f"'{b}'") for a, b in SPECIAL.items()] + [("length(word) <= 2", "word"), ("kept", "before")],
                "replace(w, 'Y', 'y')",
            )
        },
    ]


def with_stem(words: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """Adds the stem of a column of lower-case words; null stays null."""
    names = [c for c in words.columns if c != word]
    held = words.select(F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("_")).alias("_row"), F.col(f"`{word}`").alias("word"))
    for step in steps("({0} RLIKE {1})", "regexp_replace({0}, {1}, {2})"):
        held = held.withColumns({name: F.expr(text.replace("{1}", "$1")) for name, text in step.items()})
    # the outer form of a generator: a filter on the stem is not copied into all steps before it
    once = F.explode_outer(F.array("stem")).alias(out)
    return held.select(*[F.col(f"_row.`{c}`") for c in names], F.col("word").alias(word), once)


def stems_sql(words_sql: str) -> str:
    """``word, stem`` of a subquery with a column ``word``, in DuckDB's SQL."""
    columns, query = ["word"], f"(SELECT word FROM {words_sql})"
    for step in steps("regexp_matches({0}, {1})", "regexp_replace({0}, {1}, {2}, 'g')"):
        kept = [c for c in columns if c not in step]
        made = [f"{text.replace('{1}', chr(92) + '1')} AS {name}" for name, text in step.items()]
        query = f"(SELECT {', '.join(kept + made)} FROM {query})"
        columns = kept + list(step)
    return f"(SELECT word, stem FROM {query})"
